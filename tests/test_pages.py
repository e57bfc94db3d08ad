"""Pages of a feed in all shapes, whole and broken."""

from oddsloom.sources import pages, venues

SCHEMA = "id string, title string, volumeNum double, markets array<struct<outcomePrices: string>>"
PAGES = [
    '[{"id": "a", "title": "A", "volumeNum": 3}, 5, null, "x", []]',
    '{"data": [{"id": 7, "volumeNum": "4.5", "markets": [{"outcomePrices": ["0.4", "0.6"]}, {"outcomePrices": "[\\"0.1\\"]"}, {"outcomePrices": 0.25}, 3]}], "events": [{"id": "no"}]}',
    '{"data": {"id": "no"}, "events": [{"id": "c", "volumeNum": "many", "markets": {"not": "a list"}}, {"title": "no id"}]}',
    '{"message": "busy"}',
    '[{"id": "d"',
    "",
    None,
    "[]",
    '{"events": []}',
    "3",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id int, page string")


def test_events_of_all_shapes(spark):
    got = {r.id: r for r in pages.events(frame(spark), SCHEMA).collect()}
    assert set(got) == {"a", "7", "c"}
    assert (got["a"].title, got["a"].volumeNum, got["a"].markets) == ("A", 3.0, None)
    assert got["7"].volumeNum == 4.5 and [m and m.outcomePrices for m in got["7"].markets] == ['["0.4","0.6"]', '["0.1"]', "0.25", None]
    assert got["c"].volumeNum is None and got["c"].markets is None


def test_what_came_is_counted(spark):
    got = {r.shape: (r.pages, r.events, r.dropped) for r in pages.report(frame(spark), SCHEMA).collect()}
    assert got == {"array": (2, 5, 4), "data": (1, 1, 0), "events": (2, 2, 1), "other": (2, 0, 0), "corrupt": (3, 0, 0)}


def test_events_are_mapped(spark):
    page = '{"data": [{"id": "e", "title": "T", "markets": [{"question": "Q", "outcomePrices": ["0.3", "0.7"], "slug": "s"}]}]}'
    r = venues.polymarket(pages.events(spark.createDataFrame([(1, page)], "page_id int, page string"), venues.POLYMARKET)).first()
    assert (r.id, r.title, r.link, [(o["name"], o.percentage) for o in r.outcomes]) == ("polymarket:e", "T", "https://polymarket.com/event/s", [("No", 70.0), ("Yes", 30.0)])
