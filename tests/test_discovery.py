"""Variant discovery over links in circles and chains."""

from shelfspark.operators import discovery


def test_discovery_to_the_end(spark):
    pages = [("a", "f"), ("b", "f"), ("c", None), ("d", "f"), ("e", "f"), ("x", "g"), ("y", "f"), ("p", None), ("q", "g"), ("r", "f"), ("lone", "f"), (None, "f")]
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("e", "b"), ("c", "x"), ("x", "y"), ("d", "gone"), ("p", "q"), ("q", "r"), ("p", "p"), ("a", "b"), ("e", None), (None, "lone")]
    sources = [("a", "f"), ("p", None)]
    of = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = discovery.discovered(of(sources, "url string, family string"), of(links, "url string, to string"), of(pages, "url string, family string"))
    assert {r.url: (r.family, r.depth) for r in got.collect()} == {"b": ("f", 1), "c": ("f", 2), "d": ("f", 3), "e": ("f", 4), "q": ("g", 1)}
    none = discovery.discovered(of([], "url string, family string"), of(links, "url string, to string"), of(pages, "url string, family string"))
    assert none.collect() == []


def test_sources_and_seen_pages_are_not_broadcast(spark, monkeypatch):
    of = lambda rows, kind: spark.createDataFrame(rows, kind)
    plans, writer = [], type(spark.range(1).write)
    parquet = writer.parquet

    def planned(self, path, *more, **options):
        plans.append(self._df._jdf.queryExecution().sparkPlan().toString())
        return parquet(self, path, *more, **options)

    monkeypatch.setattr(writer, "parquet", planned)
    got = discovery.discovered(of([("a", "f")], "url string, family string"), of([("a", "b"), ("b", "a")], "url string, to string"), of([("a", "f"), ("b", "f")], "url string, family string"))
    assert [tuple(r) for r in got.collect()] == [("b", "f", 1)]
    rounds = [p for p in plans if "LeftAnti" in p]
    assert len(rounds) == 2 and all(p.count("LeftAnti") == 2 and not any("LeftAnti" in line and "Broadcast" in line for line in p.splitlines()) for p in rounds)
