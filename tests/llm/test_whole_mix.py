"""Registered queries over small tables: nothing is left out."""

import pytest

from waymesh.llm import queries


def test_scarce_source_does_not_shrink_the_draw(spark, tmp_path):
    sf = str(tmp_path)
    rows = [(i, "Big source" if i % 3 else "mid", f"way {i} " * 300) for i in range(200)] + [(900, "tiny", "a short text " * 40), (901, None, "no source " * 500), (902, "untargeted", "left alone " * 500)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{sf}/documents.parquet")
    goals = [("big_source", 0.3, 2), ("mid", 0.3, 2), ("tiny", 0.3, 3), ("absent", 0.1, 4)]
    spark.createDataFrame(goals, "source string, target_share double, max_repeats int").write.parquet(f"{sf}/mix_target.parquet")
    have = {r[0]: r[1] for r in queries._sizes(spark, sf).groupBy("source").sum("n_tokens").collect()}
    got = {x.source: x for x in queries.p8_shares(spark, sf).collect()}
    assert got["tiny"].drawn_tokens == 3 * have["tiny"] and got["tiny"].passes == 3 and got["tiny"].actual_share < 0.01
    assert got["absent"].drawn_tokens == 0
    assert sum(x.drawn_tokens for x in got.values()) == pytest.approx(have["Big source"] + have["mid"] + have["tiny"], rel=0.02)
    assert got["mid"].drawn_tokens == pytest.approx(got["big_source"].drawn_tokens, rel=0.03)
