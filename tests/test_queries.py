"""Registered queries against their SQL on the smallest tables, a few of each module; all of them with ALL_QUERIES=1."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from dossier import catalog

SF = "/root/testdata/sf0.001"
FEW = ["price_variation", "vat_check", "security_bands", "code_set_compare", "prefix_lookup", "char_validation", "header_paths", "clauses", "bm25_topk", "merge_findings", "duplicate_uploads", "money", "document_types", "header_rules", "table_business_types", "mandatory_clauses", "security_exceptions", "vector_topk", "link_justifications", "dense_cells", "assemble_context", "start_events", "table_complexity", "named_codes", "similar_named_codes", "cited_cells", "fill_gaps_cascade", "metrics_stream", "discovered_files", "json_index", "item_cascade_match", "supplier_columns", "penalties_by_party", "pack_chunks", "table_type", "clause_checklist", "full_audit", "facts_by_type", "arriving_packages", "offer_text_rows", "offer_requisites", "security_checks", "other_penalties", "guarded_decisions", "code_by_name", "mandatory_clauses"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "normalize"):
        return format(v.normalize(), "f")
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL) if os.environ.get("ALL_QUERIES") else FEW)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.SQL) <= set(catalog.QUERIES) <= set(entry.queries())
