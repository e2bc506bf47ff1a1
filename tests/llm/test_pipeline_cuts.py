import corpus_pipeline

from .test_substrings import brute


def test_genuine_replacement_characters_stay(spark, tmp_path):
    """The second copy begins within a character (é and \u0129 share their last byte), next to U+FFFD that the texts held."""
    shared = "".join(f"w{i * 7919 % 10007} " for i in range(120))
    rows = [(1, "first � é" + shared + "end"), (2, "other � text ĩ" + shared + "� done")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/d.parquet")
    want = {i: data.decode(errors="ignore") for (i, _), (_, data, _) in zip(rows, brute([t for _, t in rows], 400))}
    got = corpus_pipeline.cut_repeats(spark, spark.read.parquet(f"{tmp_path}/d.parquet"), str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert want[2] != rows[1][1] and "�" in want[2]
