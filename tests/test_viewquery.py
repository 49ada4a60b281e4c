"""View-query validation and the generic operator (reference test model:
query-spec validation + a 3-row daily sales stand-in with golden values)."""

import datetime as dt

import pytest

from shelfwise.operators.viewquery import (VIEWS, FilterClause, QueryValidationError, ViewDefinition, ViewQuery,
                                          kpi_cards, resolve_view, summarize, validate, view_query)
from shelfwise.sources.catalog import Catalog

COLS = ["order_date", "store_code", "store_name", "channel_name", "net_sales", "gross_sales", "order_count",
        "units_sold", "gross_profit"]


def _fixture_view(spark):
    rows = [(dt.date(2024, 1, 1), "S1", "Store One", "Online", 100.0, 110.0, 2, 5, 40.0),
            (dt.date(2024, 1, 2), "S1", "Store One", "Retail", 150.0, 160.0, 2, 6, 60.0),
            (dt.date(2024, 1, 3), "S2", "Store Two", "Online", 180.0, 200.0, 3, 9, 70.0)]
    df = spark.createDataFrame(rows, "order_date date, store_code string, store_name string, channel_name string, "
                                     "net_sales double, gross_sales double, order_count int, units_sold int, "
                                     "gross_profit double")
    base = VIEWS["sales_summary"]
    return ViewDefinition("sales_summary", lambda cat: df, base.date_columns, ("store_code", "store_name",
                          "channel_name"), base.sortable_columns, base.default_sort, tuple(COLS))


def test_identifier_safety():
    with pytest.raises(QueryValidationError):
        FilterClause("net_sales; drop", "eq", 1)
    with pytest.raises(QueryValidationError):
        ViewQuery(sort_by="1bad")
    with pytest.raises(QueryValidationError):
        ViewQuery(columns=("ok", "no-way"))
    with pytest.raises(QueryValidationError):
        ViewQuery(columns=())


def test_page_bounds_and_date_order():
    with pytest.raises(QueryValidationError):
        ViewQuery(page=0)
    with pytest.raises(QueryValidationError):
        ViewQuery(page_size=501)
    with pytest.raises(QueryValidationError):
        ViewQuery(date_from=dt.date(2024, 2, 1), date_to=dt.date(2024, 1, 1))
    with pytest.raises(QueryValidationError):
        ViewQuery(search="x" * 201)


def test_allow_lists():
    view = VIEWS["sales_summary"]
    cols = list(view.allowed_columns)
    with pytest.raises(QueryValidationError):
        validate(ViewQuery(sort_by="store_id"), view, cols)  # not sortable
    with pytest.raises(QueryValidationError):
        validate(ViewQuery(filters=(FilterClause("secret", "eq", 1),)), view, cols)
    with pytest.raises(QueryValidationError):
        validate(ViewQuery(columns=("secret",)), view, cols)
    with pytest.raises(QueryValidationError):
        validate(ViewQuery(filters=(FilterClause("store_code", "in", "S1"),)), view, cols)  # IN needs a list
    with pytest.raises(QueryValidationError):
        validate(ViewQuery(filters=(FilterClause("store_code", "is_null", "x"),)), view, cols)
    with pytest.raises(QueryValidationError):
        validate(ViewQuery(date_from=dt.date(2024, 1, 1)), VIEWS["sales_trends"], ["year_number"])
    q = validate(ViewQuery(date_from=dt.date(2024, 1, 1)), view, cols)
    assert q.sort_by == "order_date" and q.date_column == "order_date"


def test_override_resolves_other_view():
    assert resolve_view("sales_summary", {"sales_summary": "sales_trends"}).key == "sales_trends"
    with pytest.raises(QueryValidationError):
        resolve_view("nope")


def test_every_problem_is_told_at_once():
    with pytest.raises(QueryValidationError) as e:
        ViewQuery(page=0, page_size=0, sort_dir="up", sort_by="a b", columns=())
    assert len(e.value.problems) == 5
    view = VIEWS["sales_summary"]
    with pytest.raises(QueryValidationError) as e:
        validate(ViewQuery(sort_by="store_id", columns=("secret",), filters=(FilterClause("store_code", "in", "S1"), FilterClause("other", "gt", 1)),
                           date_from=dt.date(2024, 1, 1), date_column="net_sales"), view, list(view.allowed_columns))
    assert len(e.value.problems) == 5


def test_override_reads_a_stored_view_with_the_base_lists(spark):
    base = _fixture_view(spark).build(None)
    base.createOrReplaceGlobalTempView("daily_stand_in")
    page = view_query(Catalog(spark, {}), "sales_summary", ViewQuery(sort_by="net_sales", columns=("net_sales",)),
                      overrides={"sales_summary": "global_temp.daily_stand_in"})
    assert [r.net_sales for r in page.rows.collect()] == [180.0, 150.0, 100.0]
    with pytest.raises(QueryValidationError):
        view_query(Catalog(spark, {}), "sales_summary", ViewQuery(sort_by="store_name"), overrides={"sales_summary": "global_temp.daily_stand_in"})
    for bad in ("a.b; drop", "a..b", "nope", "a.b.c.d"):
        with pytest.raises(QueryValidationError):
            resolve_view("sales_summary", {"sales_summary": bad})


@pytest.mark.parametrize("clause, rows", [(("store_code", "ne", "S1"), 1), (("net_sales", "gt", 100.0), 2), (("net_sales", "gte", 100.0), 3), (("net_sales", "lt", 150.0), 1),
                                          (("net_sales", "lte", 150.0), 2), (("channel_name", "in", ["Online"]), 2), (("store_name", "like", "%Two"), 1),
                                          (("store_name", "ilike", "%two"), 1), (("store_name", "is_null"), 0), (("store_name", "is_not_null"), 3)])
def test_every_operator(spark, clause, rows):
    assert view_query(Catalog(spark, {}), _fixture_view(spark), ViewQuery(filters=(FilterClause(*clause),))).rows.count() == rows


def test_filter_sort_page(spark):
    cat = Catalog(spark, {})
    page = view_query(cat, _fixture_view(spark), ViewQuery(filters=(FilterClause("store_code", "eq", "S1"),),
                                                           sort_by="order_date", sort_dir="asc"))
    rows = page.rows.collect()
    assert len(rows) == 2 and rows[0]["net_sales"] == 100.0
    assert page.total.first()["total_items"] == 2


def test_date_range_and_projection(spark):
    cat = Catalog(spark, {})
    q = ViewQuery(date_from=dt.date(2024, 1, 2), date_to=dt.date(2024, 1, 3), columns=("order_date", "net_sales"))
    rows = view_query(cat, _fixture_view(spark), q).rows.collect()
    assert len(rows) == 2 and len(rows[0]) == 2


def test_search_and_pages_are_disjoint(spark):
    cat = Catalog(spark, {})
    v = _fixture_view(spark)
    assert view_query(cat, v, ViewQuery(search="two")).rows.count() == 1
    p1 = view_query(cat, v, ViewQuery(page=1, page_size=2, sort_by="net_sales")).rows.collect()
    p2 = view_query(cat, v, ViewQuery(page=2, page_size=2, sort_by="net_sales")).rows.collect()
    assert [r.net_sales for r in p1 + p2] == [180.0, 150.0, 100.0]


def test_summarize_golden(spark):
    cat = Catalog(spark, {})
    s = summarize(cat, _fixture_view(spark), ViewQuery(), ["net_sales", "order_count"]).first()
    assert s["net_sales"] == 430.0 and s["order_count"] == 7.0


def test_kpi_cards_shape(spark):
    from shelfwise.sources.catalog import Catalog as C
    cat = C.from_tpch(spark, "/root/testdata/sf0.001")
    rows = kpi_cards(cat, "finance").collect()
    assert [r.id for r in rows] == ["gross_sales", "cogs", "gross_profit", "discounts"]


def test_page_dto(spark):
    cat = Catalog(spark, {})
    dto = view_query(cat, _fixture_view(spark), ViewQuery(page=1, page_size=2, sort_by="net_sales")).to_dict()
    assert dto["pagination"] == {"page": 1, "page_size": 2, "total_items": 3, "total_pages": 2}
    assert dto["columns"][0] == {"key": "order_date", "label": "Order Date"} and len(dto["rows"]) == 2


def test_loose_coercion(spark):
    from shelfwise.functions.expr import loose_bool, loose_date, loose_float
    df = spark.createDataFrame([("2024-01-05", "1.5", "Yes"), ("junk", "x", "maybe")], "d string, f string, b string")
    r = df.select(loose_date("d").alias("d"), loose_float("f").alias("f"), loose_bool("b").alias("b")).collect()
    assert (r[0].d, r[0].f, r[0].b) == (dt.date(2024, 1, 5), 1.5, True)
    assert (r[1].d, r[1].f, r[1].b) == (None, None, None)
