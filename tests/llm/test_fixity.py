from __future__ import annotations

import hashlib

from corpusloom.llm import fixity

SCHEMA = "page_id long, url string, html string, stored string, offset long, digest string"


def pages(spark, n=3000):
    rows = [(i, f"u{i}", f"<p>é{i}</p>" * (i % 50), None) for i in range(n)]
    rows += [(None, None, None, None), (7, "u7", "<p>again</p>", None), (7, "u7", "<p>again</p>", None)]
    rows += [(9, None, "x" * 300_000, None), (10, "u", "", None)]
    bad = {5: "rot", 1501: None, 2999: "cut"}
    made = [(i, u, h, bad.get(i, h) if u == f"u{i}" else h, 1, "d") for i, u, h, _ in rows]
    return spark.createDataFrame(made, SCHEMA).repartition(4)


def test_places_and_digests(spark):
    got = fixity.archive(pages(spark)).toPandas()
    for _, volume in got.sort_values("offset").groupby(["volume", "part"]):
        assert (volume["offset"] == volume["length"].cumsum() - volume["length"]).all()
        assert volume["page_id"].dropna().is_monotonic_increasing
    r = got[got["page_id"] == 12].iloc[0]
    html = "<p>é12</p>" * 12
    text = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:12>\r\nWARC-Target-URI: u12\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n"
    assert r["digest"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["length"] == len(text.encode())


def test_damage_is_located(spark):
    good = fixity.archive(pages(spark))
    held = fixity.archive(pages(spark), "stored").filter("page_id IS NULL OR page_id <> 44")
    got = {r["page_id"]: r for r in fixity.audit(good, held).collect()}
    assert {i: r["kind"] for i, r in got.items()} == {5: "changed", 1501: "changed", 2999: "changed", 44: "missing"}
    assert got[44]["found_sha256"] is None
    back = {r["page_id"]: r["kind"] for r in fixity.audit(held, good).collect()}
    assert back[44] == "extra" and len(back) == 4


def test_only_mismatching_branches_are_kept(spark):
    good = fixity.archive(pages(spark))
    held = fixity.archive(pages(spark), "stored")
    size = good.selectExpr("max(offset) o", "max(volume) v").first()
    a, b = (fixity.tree(x, size["o"] // fixity.RANGE + 1, size["v"] + 1) for x in (good, held))
    assert a[-1].filter("volume = 0").first()["hash"] != b[-1].filter("volume = 0").first()["hash"]
    node = ["volume", "part", "place", "hash"]
    assert 0 < a[0].select(node).exceptAll(b[0].select(node)).count() <= 3


def test_equal_and_empty_replicas(spark):
    good = fixity.archive(pages(spark, 30))
    assert fixity.audit(good, good).count() == 0
    assert fixity.audit(good, good.limit(0)).count() == good.count()
    none = good.limit(0)
    assert fixity.audit(none, none).count() == 0
