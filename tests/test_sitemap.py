"""The site map written and read back."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tallymark.operators import sitemap

NS = f"{{{sitemap.XMLNS}}}"


def test_site_map_tree(spark, tmp_path):
    groups = [(f"w&{k:03d}", "i" if k % 10 else None, k % 12, k % 4) for k in range(120)] + [("tipo-tinto", "i", 3, 1), ("x-categoria-y", "i", 3, 1), ("1888", "i", 3, 1)]
    groups = spark.createDataFrame(groups, "group_slug string, image_url string, store_count int, in_stock_offer_count int").repartition(5)
    brands = spark.createDataFrame([(f"b{k}", k % 12) for k in range(40)] + [(None, 9)], "slug string, store_count int")
    grapes = spark.createDataFrame([("malbec", 80), ("syrah", 3)], "slug string, group_count int")
    entries = sitemap.wine_entries(groups)
    for pages, kind in ((brands, "bodegas"), (grapes, "varietals"), (grapes, "regions"), (grapes, "rankings"), (grapes, "vs"), (grapes, "blog")):
        entries = entries.unionByName(sitemap.page_entries(pages, kind))
    entries = entries.unionByName(sitemap.static_entries(spark)).unionByName(sitemap.static_entries(spark))
    sitemap.write(entries, str(tmp_path), "https://x.example", "2026-01-02T00:00:00.000Z", chunk=25)
    found = {}
    for folder in (tmp_path / "pages").glob("bucket=*"):
        (file,) = folder.glob("part-*")
        root = ET.fromstring(file.read_text())
        found[folder.name.removeprefix("bucket=")] = [(u.find(f"{NS}loc").text, u.find(f"{NS}changefreq").text, u.find(f"{NS}priority").text, u.find(f"{NS}lastmod").text) for u in root]
    wines = [f"w&{k:03d}" for k in range(120) if k % 10]
    assert all(len(x) <= 25 for x in found.values())
    assert [u[0] for k in range(1, 6) for u in found[f"vinos-{k}"]] == [f"https://x.example/vino/{w}" for w in wines]
    brands_left = sorted(f"https://x.example/bodega/b{k}" for k in range(40) if k % 12 >= 2)
    assert [u[0] for u in found["bodegas"] + found["bodegas-2"]] == brands_left
    assert set(found) == {"static", "bodegas", "bodegas-2", "varietals", "regions", "rankings", "vs", "blog", *[f"vinos-{k}" for k in range(1, 6)]}
    by = {u[0]: u[1:3] for x in found.values() for u in x}
    assert by["https://x.example/vino/w&004"] == ("weekly", "0.20") and by["https://x.example/vino/w&011"] == ("daily", "0.90") and by["https://x.example/vino/w&001"] == ("daily", "0.40")
    assert by["https://x.example/varietal/malbec"][1] == "0.90" and by["https://x.example/region/malbec"][1] == "0.80" and by["https://x.example/region/syrah"][1] == "0.60"
    assert by["https://x.example/vs/syrah"] == ("weekly", "0.40") and by["https://x.example/"] == ("daily", "1.00") and len(found["static"]) == len(sitemap.STATIC)
    (index,) = (tmp_path / "index").glob("part-*")
    named = [s.find(f"{NS}loc").text.removeprefix("https://x.example/sitemap/").removesuffix(".xml") for s in ET.fromstring(index.read_text())]
    assert named == sorted(found)


def test_empty_site_map(spark):
    none = sitemap.static_entries(spark).limit(0)
    assert sitemap.documents(sitemap.bucketed(none), "b", "t").count() == 0
    assert sitemap.index(none.select(F.col("bucket")), "b", "t").first().xml.count("<loc>") == 0
