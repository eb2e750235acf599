"""Granule search in a public catalogue: addresses of requests, pages of answers, links of granules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalogue's collection of each mission product and version, its address, and the hosts whose links
# it gives out of date.
COLLECTIONS = {
    "GEDI01_B.002": "C2142749196-LPCLOUD",
    "GEDI02_A.002": "C2142771958-LPCLOUD",
    "GEDI02_B.002": "C2142776747-LPCLOUD",
    "GEDI03.002": "C2153683336-ORNL_CLOUD",
    "GEDI04_A.001": "C2734289572-ORNL_CLOUD",
    "GEDI04_A.002": "C2237824918-ORNL_CLOUD",
    "GEDI04_B.002": "C2244602422-ORNL_CLOUD",
}
SEARCH = "https://cmr.earthdata.nasa.gov/search/granules.json?pretty=true&project=GEDI&page_size=2000"
GRIDDED, OLD_HOST, NEW_HOST = "GEDI03", "data.ornldaac.earthdata.nasa.gov/protected", "daac.ornl.gov/daacdata"

ANSWER = "feed struct<entry: array<struct<links: array<struct<href: string>>>>>, errors array<string>"


class SearchFailed(RuntimeError):
    pass


def search_url(product: str, ul_lat: float, ul_lon: float, lr_lat: float, lr_lon: float, version: str = "002", daterange: tuple[str, str] | None = None, page: int = 1) -> str:
    """The request for one page: the box as west, south, east, north."""
    key = f"{product}.{version}"
    if key not in COLLECTIONS:
        raise ValueError(f"no collection of {key}")
    temporal = f"&temporal={daterange[0]},{daterange[1]}" if daterange else ""
    return f"{SEARCH}&concept_id={COLLECTIONS[key]}&bounding_box={ul_lon},{lr_lat},{lr_lon},{ul_lat}{temporal}&pageNum={page}"


def search_urls(boxes: DataFrame, product: str, version: str = "002", daterange: tuple[str, str] | None = None) -> DataFrame:
    """The first request for each box of a table (west, south, east, north), beside its columns as `url`."""
    key = f"{product}.{version}"
    if key not in COLLECTIONS:
        raise ValueError(f"no collection of {key}")
    temporal = f"&temporal={daterange[0]},{daterange[1]}" if daterange else ""
    box = F.concat_ws(",", *(F.col(c).cast("string") for c in ("west", "south", "east", "north")))
    return boxes.withColumn("url", F.concat(F.lit(f"{SEARCH}&concept_id={COLLECTIONS[key]}&bounding_box="), box, F.lit(f"{temporal}&pageNum=1")))


def first_links(answers: DataFrame, product: str, body: str = "body") -> DataFrame:
    """(page, position, href): the first link of every granule of answers (page, body)."""
    parsed = answers.select("page", F.from_json(body, ANSWER).alias("a")).select("page", F.posexplode("a.feed.entry").alias("position", "e"))
    href: Column = F.get("e.links", F.lit(0))["href"]
    return parsed.select("page", "position", (F.replace(href, F.lit(OLD_HOST), F.lit(NEW_HOST)) if product == GRIDDED else href).alias("href"))


def find_granules(spark: SparkSession, fetch: Callable[[str], tuple[int, str]], product: str, ul_lat: float, ul_lon: float, lr_lat: float, lr_lon: float, version: str = "002", daterange: tuple[str, str] | None = None) -> DataFrame:
    """Pages until an empty one. fetch(url) gives a status and a body; any status but 200 is an error with its texts."""
    import json

    pages = []
    while True:
        page = len(pages) + 1
        status, body = fetch(search_url(product, ul_lat, ul_lon, lr_lat, lr_lon, version, daterange, page))
        answer = json.loads(body)
        if status != 200:
            raise SearchFailed("\n".join(answer.get("errors", [])))
        if not answer.get("feed", {}).get("entry"):
            break
        pages.append((page, body))
    return first_links(spark.createDataFrame(pages, "page int, body string"), product)


def fetch(url: str, timeout: float = 30) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as r:
            return r.status, r.read().decode()
    except HTTPError as e:
        return e.code, e.read().decode()
