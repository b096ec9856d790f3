"""What plans read and carry."""

import re

import pytest

from mnemosa.plans.memory_queries import QUERIES

WIDE = {"content", "embedding", "verbatim", "summary_embedding"}
SLIM = ["facts_newest", "entity_stats", "fact_labels", "recent_messages", "open_threads_topk", "facts_filtered", "ttl_assigned", "expired_split", "reinforced", "slot_supersede", "conscious_topk", "turn_ranges", "ingest_chunks", "turn_summaries", "active_conversations"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SLIM)
def test_reads_no_wide_column(spark, small, name):
    df = QUERIES[name](spark, small)
    if name == "ingest_chunks":  # written while the plan is built: its source shows in the files' columns
        assert not WIDE & set(df.columns)
        return
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", plan(df), re.M)
    assert schemas and all("..." not in s for s in schemas)
    for s in schemas:
        assert not WIDE & {c.split(":")[0] for c in s.split(",")}, s


def test_record_state_is_cut_before_the_shuffle(spark, small):
    for name in ("facts_newest", "recent_messages", "turn_summaries"):
        text = plan(QUERIES[name](spark, small))
        assert text.count("WindowGroupLimit") >= 2 and "IsNotNull(uuid)" in text
