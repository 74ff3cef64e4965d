from artifactgate.llm import preferences


def test_prefix_masks_and_edge_cases(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes é"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "x"), (1, 3, "assistant", None),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, "alone"), (None, 0, "user", "lost"),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, pair_id int, prompt string")
    out = {r.pair_id: r for r in preferences.report(frame).collect()}
    assert set(out) == {0, 1, 2}
    assert out[0].prompt == "<|im_start|>user\nhi<|im_end|>\n" and out[0].n_prompt_turns == 1
    for text, mask, want in ((out[0].chosen, out[0].chosen_mask, ["yes é<|im_end|>"]), (out[0].rejected, out[0].rejected_mask, ["no<|im_end|>", "<|im_end|>"])):
        assert [text[slice(*map(int, m.split(":")))] for m in mask.split(",")] == want
    assert (out[1].n_prompt_turns, out[1].chosen, out[1].rejected) == (1, "", "")
    assert (out[2].prompt, out[2].chosen, out[2].rejected, out[2].chosen_mask) == ("", "<|im_start|>unknown\nalone<|im_end|>\n", "", "")
    assert preferences.report(frame.limit(0)).count() == 0
