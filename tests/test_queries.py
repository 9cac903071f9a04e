import glob
import html
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import SF, same
from townhall.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE[name])


#: Queries of operators whose cases of null, tied and repeated rows no other test has.
ODD = """current_holders vacant_offices latest_tenure last_holders seat_detail place_cards seats_of_district segments_of_parent hierarchy_load seat_search person_search
freshness sla_status pool_stats run_report level_buckets latest_point facility_share year_panel indicator_series point_in_polygon merge_polygons geojson_bbox overlap_assign overlap_audit
geometry_audit geometry_coverage feature_load bindings_collapse column_calibration table_select table_grid listing_rows positional_rows registry_load payload_pages section_fill
publish_gate cluster_numbers name_forms election_results json_text_order dbf_attributes shapefile_areas dissolved_areas ring_problems repaired_areas overlap_slanted stream_clusters
listing_match person_match seat_match linkage_layers lexicon_hits""".split()


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    """Two folders of tables: empty ones, and some rows with repeated ones and one of nulls."""
    empty, odd = str(tmp_path_factory.mktemp("empty")), str(tmp_path_factory.mktemp("odd"))
    for path in glob.glob(f"{SF}/*.parquet"):
        some = duckdb.sql(f"select * from '{path}' limit 0")
        nulls = ", ".join(f"null::{t} as {c}" for c, t in zip(some.columns, some.types, strict=True))
        rows = f"(select * from '{path}' limit 40) union all (select * from '{path}' limit 3) union all select {nulls}"
        for folder, q in ((empty, f"select * from '{path}' limit 0"), (odd, rows)):
            duckdb.sql(f"copy ({q}) to '{folder}/{os.path.basename(path)}' (format parquet)")
    return empty, odd


@pytest.mark.parametrize("name", sorted(ODD))
def test_empty_and_odd_tables(spark, odd_tables, name):
    over_nothing, over_odd = (catalog.QUERIES[name](spark, folder) for folder in odd_tables)
    assert over_nothing.columns == over_odd.columns
    assert len(over_nothing.collect()) <= 1  # totals have a row over nothing
    over_odd.collect()


def test_streams_are_the_same_each_time(spark):
    for _ in range(2):
        same(spark, catalog.QUERIES["stream_windows"], catalog.ORACLE["stream_windows"])


def test_excerpts_of_all_pages(spark):
    got = catalog.QUERIES["page_excerpts"](spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(len(r["excerpt"]) <= 2500 for r in got)
    for r in got:  # every line of an excerpt stands in its page, in order
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", pages[r["page_id"]])).split())
        lines, at = r["excerpt"].split("\n"), -1
        for line in lines[1:-1]:
            at = text.find(" ".join(line.split()), at + 1)
            assert at >= 0 and len(line) > 60


def excerpt_by_force(page):
    """Tags and text one after the other, by a pattern instead of a parser."""
    found, inside, skip, text, meta = {"article": [], "main": [], "page": []}, {"article": 0, "main": 0}, 0, None, None

    def close():
        nonlocal text
        words = " ".join(html.unescape(text or "").split())
        for where in [k for k, n in inside.items() if n] + ["page"] if words else []:
            found[where].append(words)
        text = None

    page = re.sub(r"(?s)<!--.*?-->", "", page)
    for tag, plain in re.findall(r"(?s)(<[/a-zA-Z][^>]*>)|((?:[^<]|<(?![/a-zA-Z]))+)", page):
        name = re.match(r"</?([a-zA-Z0-9]*)", tag)[1].lower() if tag else ""
        if not tag:
            text = text + plain if text is not None and not skip else text
        elif name in ("script", "style"):
            skip = max(0, skip + (-1 if tag[1] == "/" else 1))
        elif name == "p":
            close()
            text = None if tag[1] == "/" else ""
        elif name in inside:
            if tag[1] == "/":
                close()
            inside[name] = max(0, inside[name] + (-1 if tag[1] == "/" else 1))
        elif name == "meta" and re.search(r"""(?:property|name)=["']?og:description["' ]""", tag) and meta is None:
            meta = " ".join(html.unescape(re.search(r"""content=(?:"([^"]*)"|'([^']*)')""", tag)[1] or "").split()) or None
    close()
    parts = dict.fromkeys(([meta] if meta else []) + [t for t in found["article"] or found["main"] or found["page"] if len(t) > 60])
    return "\n".join(parts)[:2500]


def test_excerpts_by_force(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["excerpt"] for r in catalog.QUERIES["page_excerpts"](spark, SF).collect()}
    assert got == {i: excerpt_by_force(page) for i, page in pages.items()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
