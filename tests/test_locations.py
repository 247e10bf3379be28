"""Known places of tools."""

from shelfmark.sources.locations import known_locations


def test_known_locations(spark, tmp_path):
    homes = [str(tmp_path / h) for h in ("ann", "bo", "none")]
    for path in ("ann/.cache/huggingface/hub", "ann/.ollama", "bo/tessdata", "bo/.cache/torch", "elsewhere/hf"):
        (tmp_path / path).mkdir(parents=True)
    (tmp_path / "bo" / "linked").symlink_to(tmp_path / "bo" / ".cache" / "torch")
    found = lambda **e: {(r["tool"], r["path"].removeprefix(str(tmp_path))) for r in known_locations(spark, homes, e).collect()}
    assert found() == {("huggingface", "/ann/.cache/huggingface"), ("ollama", "/ann/.ollama"), ("torch", "/bo/.cache/torch")}
    (tmp_path / "bo" / "tessdata" / "eng.traineddata").write_text("x")
    # a variable names a place; one that is inside another, or a link to it, is the same place
    more = found(HF_HOME=str(tmp_path / "elsewhere" / "hf"), HF_HUB_CACHE=str(tmp_path / "ann" / ".cache" / "huggingface" / "hub"), TORCH_HOME=str(tmp_path / "bo" / "linked"))
    assert more == found() | {("huggingface", "/elsewhere/hf")} and ("tesseract", "/bo/tessdata") in more
