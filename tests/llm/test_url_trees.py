"""The verdict of the trees: against labels that they haven't seen, and on urls that no rule decides."""

from locusframe.llm import url_filter

SF = "/root/testdata/sf0.1"


def test_unseen_labels(spark):
    got = url_filter.held_out_quality(spark.read.parquet(f"{SF}/pages.parquet"))
    assert got["blocked"] > 20 and got["precision"] >= 0.8 and got["recall"] >= 0.8, got


def test_a_suffix_alone_blocks_no_url(spark):
    """Of urls under .net only those in two languages are labelled to block; the others aren't blocked for their suffix."""
    found = url_filter.op6_url_filter(spark, SF).filter("rule is null").collect()
    net = [r for r in found if r["host"].endswith(".net")]
    assert len(net) > 20 and sum(r["verdict"] == "block" for r in net) <= 0.1 * len(net)


def test_labels_of_its_own(spark):
    """Long paths with digits are labelled to block, short ones to allow, some are left out."""
    rows = [(i, f"https://h{i}.org/" + (f"{i:09d}/" * 4 if i % 2 else "about")) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = url_filter.F.when(url_filter.F.col("page_id") % 5 != 0, url_filter.F.col("page_id") % 2)
    found = {r["page_id"]: r for r in url_filter.judge(pages, (), labels).collect()}
    assert sum(found[i]["verdict"] == ("block" if i % 2 else "allow") for i in found) >= 270
    assert all(0 <= r["block_probability"] <= 1 and r["rule"] is None for r in found.values())
