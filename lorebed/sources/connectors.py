"""Sources on the network as Spark data sources: wikis, sitemaps, lists of URLs; newsletters and crawls of links.

``spark.read.format("wiki").option("api", ...)``, ``format("sitemap").option("url", ...)``: what there is to read is listed once on the
driver, as names alone, dealt to partitions of ``per_task`` names, and fetched on the executors. A page that can't be
fetched is a row with its error, so nothing vanishes. ``option("fetch", "module:function")`` names another way to fetch.
"""

from __future__ import annotations

import html
import importlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from http.client import HTTPException
from urllib.parse import quote, urljoin
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str], str]
PAGE = "url string, title string, content string, source string, error string"
#: What a failed page raises: no connection, a bad URL, a cut answer, an answer of another form.
FAILURES = (OSError, ValueError, HTTPException, KeyError, TypeError, AttributeError)


def fetch(url: str, timeout: float = 30.0) -> str:
    with urlopen(Request(url, headers={"User-Agent": "lorebed"}), timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode("utf-8", "replace")


def _ask(api: str, get: Fetch, **query: str) -> dict:
    return json.loads(get(api + "?" + "&".join(f"{k}={quote(str(v), safe='')}" for k, v in {**query, "format": "json"}.items())))


def _listed(api: str, get: Fetch, name: str, start: dict[str, str]) -> Iterator[str]:
    """Titles of a list query, following its continuation."""
    more: dict[str, str] = {}
    while True:
        answer = _ask(api, get, action="query", list=name, **start, **more)
        for row in answer["query"][name]:
            yield row["title"] if "title" in row else row["*"]
        more = {k: v for k, v in answer.get("continue", {}).items() if k != "continue"}
        if not more:
            return


def wiki_titles(api: str, get: Fetch = fetch, batch: int = 500) -> Iterator[str]:
    """All page titles of a MediaWiki."""
    return _listed(api, get, "allpages", {"aplimit": str(batch)})


def wiki_search(api: str, text: str, get: Fetch = fetch, batch: int = 50) -> Iterator[str]:
    """Titles that a MediaWiki finds."""
    return _listed(api, get, "search", {"srsearch": text, "srlimit": str(batch)})


def wiki_category(api: str, category: str, get: Fetch = fetch, batch: int = 500) -> Iterator[str]:
    """Titles of pages in a category."""
    name = category if ":" in category else f"Category:{category}"
    return _listed(api, get, "categorymembers", {"cmtitle": name, "cmtype": "page", "cmlimit": str(batch)})


def wiki_categories(api: str, get: Fetch = fetch, batch: int = 500) -> Iterator[str]:
    """Names of all categories."""
    return _listed(api, get, "allcategories", {"aclimit": str(batch)})


def wiki_page(api: str, title: str, get: Fetch = fetch, least: int = 100) -> tuple[str, str] | None:
    """(title, text) by the extract interface, else from the page itself, else by the parse interface; None if all give less than ``least``."""
    from ..operators.extract import page_text

    name = title.replace(" ", "_")

    def extract() -> str:
        pages = _ask(api, get, action="query", prop="extracts", explaintext="1", titles=name)["query"]["pages"]
        return next(iter(pages.values())).get("extract", "")

    ways = (
        extract,
        lambda: page_text(get(urljoin(api, "/wiki/") + quote(name))),
        lambda: page_text(_ask(api, get, action="parse", page=name).get("parse", {}).get("text", {}).get("*", "")),
    )
    failed = None
    for way in ways:
        try:
            text = way()
        except FAILURES as error:
            failed = failed or error
            continue
        if len(text) >= least:
            return title, text
    if failed:
        raise failed
    return None


def sitemap_urls(url: str, get: Fetch = fetch, depth: int = 3) -> Iterator[str]:
    """URLs of a sitemap and of those that it lists."""
    text = get(url)
    found = [html.unescape(x) for x in re.findall(r"<loc>\s*(.*?)\s*</loc>", text, re.DOTALL)]
    if "<sitemapindex" in text:
        for inner in found if depth else []:
            yield from sitemap_urls(inner, get, depth - 1)
    else:
        yield from found


def page_at(url: str, get: Fetch = fetch) -> tuple[str, str]:
    """(title, text) of a web page."""
    from ..operators.extract import page_text

    page = get(url)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    return (html.unescape(title[1].strip()) if title else url), page_text(page)


def _way(options: dict[str, str]) -> Fetch:
    if "fetch" not in options:
        return fetch
    module, name = options["fetch"].split(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Names(InputPartition):
    """What one task fetches."""

    names: list[str]


class _Reader(DataSourceReader):
    """Lists names on the driver, fetches them in tasks."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.source = options.get("source", "")

    def names(self, get: Fetch) -> Iterator[str]:
        raise NotImplementedError

    def one(self, name: str, get: Fetch) -> tuple[str, str, str] | None:
        raise NotImplementedError

    def partitions(self):
        names, size = list(self.names(_way(self.options))), int(self.options.get("per_task", "200"))
        return [Names(names[i : i + size]) for i in range(0, len(names), size)] or [Names([])]

    def read(self, partition):
        get = _way(self.options)
        for name in partition.names:
            try:
                found = self.one(name, get)
            except FAILURES as error:
                yield (name, None, None, self.source, f"{type(error).__name__}: {error}")
                continue
            if found:
                yield (*found, self.source, None)


class _WikiReader(_Reader):
    def names(self, get):
        api = self.options["api"]
        if "search" in self.options:
            return wiki_search(api, self.options["search"], get)
        return wiki_category(api, self.options["category"], get) if "category" in self.options else wiki_titles(api, get)

    def one(self, name, get):
        found = wiki_page(self.options["api"], name, get)
        return found and (urljoin(self.options["api"], "/wiki/") + quote(name.replace(" ", "_")), *found)


class _SitemapReader(_Reader):
    def names(self, get):
        return sitemap_urls(self.options["url"], get)

    def one(self, name, get):
        return (name, *page_at(name, get))


class WikiSource(DataSource):
    """Pages of a MediaWiki: options api, and category or search for a part."""

    @classmethod
    def name(cls):
        return "wiki"

    def schema(self):
        return PAGE

    def reader(self, schema):
        return _WikiReader(self.options)


class SitemapSource(WikiSource):
    """Pages that a sitemap lists: option url."""

    @classmethod
    def name(cls):
        return "sitemap"

    def reader(self, schema):
        return _SitemapReader(self.options)


#: Data sources by name.
CONNECTORS = {"wiki": WikiSource, "sitemap": SitemapSource}


def register(spark: SparkSession) -> None:
    """Make the data sources known to a session."""
    for source in CONNECTORS.values():
        spark.dataSource.register(source)


def read_urls(spark: SparkSession, urls: DataFrame, source: str, get: Fetch = fetch) -> DataFrame:
    """Fetch a column of URLs on the executors: url, title, content, source, error."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, *page_at(url, get), source, None))
                except FAILURES as error:
                    rows.append((url, None, None, source, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["url", "title", "content", "source", "error"])

    return urls.select("url").mapInPandas(run, PAGE)


def crawl(spark: SparkSession, start: list[str], links: Callable[[DataFrame], DataFrame], path: str, depth: int = 2) -> DataFrame:
    """URLs within ``depth`` links of the start: each round reads the frontier and keeps what was not seen before.

    A round is written below ``path`` before the next one reads it, so that no page is fetched twice and a crawl that
    stopped goes on after the last whole round.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(k: int) -> str:
        return f"{path}/depth={k}"

    def done(k: int) -> bool:
        return files.exists(hadoop(at(k) + "/_SUCCESS"))

    if not done(0):
        spark.createDataFrame([(u,) for u in dict.fromkeys(start)], "url string").write.mode("overwrite").parquet(at(0))
    seen = spark.read.schema("url string").parquet(at(0)).withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        if not done(k):
            frontier = spark.read.schema("url string").parquet(at(k - 1))
            found = links(frontier).select("url").distinct().join(seen, "url", "left_anti")
            found.write.mode("overwrite").parquet(at(k))
        seen = seen.unionByName(spark.read.schema("url string").parquet(at(k)).withColumn("depth", F.lit(k)))
    return seen


def newsletter(spark: SparkSession, path: str) -> DataFrame:
    """A newsletter's export of posts, published ones."""
    posts = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return posts.filter(F.lower(F.coalesce("is_published", F.lit("true"))) == "true")


def backup(spark: SparkSession, urls: DataFrame, path: str, source: str, get: Fetch = fetch, least: int = 100) -> DataFrame:
    """Fetch what the backup at ``path`` lacks: URLs not there yet, and those that failed or came too short. Returns the whole backup.

    Each call is a numbered part of the table, so a stopped one is fetched again and a whole one never; of several
    copies of a page the latest sound one counts.
    """
    from .store import Store

    store = Store(spark, path)
    kind = PAGE + ", part int"
    parts = sorted({int(n.split("/")[0][5:]) for n, _ in store.list("part=") if n.endswith("/_SUCCESS")})

    def pages() -> DataFrame:
        if not parts:
            return spark.createDataFrame([], kind + ", sound boolean")
        read = [spark.read.schema(PAGE).parquet(f"{path}/part={k}").withColumn("part", F.lit(k)) for k in parts]
        whole = read[0]
        for df in read[1:]:
            whole = whole.unionByName(df)
        whole = whole.withColumn("sound", F.col("error").isNull() & (F.length("content") >= least))
        best = F.max_by(F.struct("title", "content", "source", "error", "part", "sound"), F.struct("sound", "part")).alias("b")
        return whole.groupBy("url").agg(best).select("url", "b.*")

    left = urls.select("url").filter("url is not null").distinct().join(pages().filter("sound").select("url"), "url", "left_anti")
    if not left.isEmpty():
        k = parts[-1] + 1 if parts else 0
        read_urls(spark, left, source, get).write.mode("overwrite").parquet(f"{path}/part={k}")
        parts.append(k)
    return pages()
