"""The pipeline's SimHash stage links what SimHash links."""

import corpus_pipeline
from calibrant.llm import simhash


def test_stage_links_by_fingerprints(spark):
    """Texts of one phrase over and over, each with an end of its own: fingerprints are equal, sets of shingles are not alike."""
    phrase = "one two three " * 300
    ends = [" ".join(f"{c}{i}" for i in range(12)) for c in "abc"]
    other = " ".join(f"w{i}" for i in range(200))
    rows = [(i, phrase + e, "en", "s", 1) for i, e in enumerate(ends)] + [(7, other, "en", "s", 1), (8, None, "en", "s", 1), (9, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r.component_id for r in simhash.groups(docs.where("doc_id < 3")).collect()}) == 1
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [0, 7, 8]
