"""Paged web APIs as Python data sources behind a replaceable transport.

A transport is a function from (URL, parameters) to parsed JSON. The default uses the standard
library; tests give a fake one by import path, so that executors can load it too.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGES = 60
#: Authors whose posts are left out, of threads and of forums (fixed values).
SKIPPED_AUTHORS = frozenset(("automoderator", "[deleted]", "lss_this", "gezi_bot"))
SKIPPED_POSTERS = frozenset(("system", "discobot"))


def http_json(url: str, params: dict, retries: int = 3, wait: float = 5.0) -> dict:
    """GET with retries; waits double, and are longer after 429."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=30) as answer:
                return json.load(answer)
        except OSError as failed:
            if attempt == retries:
                raise
            time.sleep(20.0 if getattr(failed, "code", 0) == 429 else wait * 2**attempt)
    return {}


def transport(path: str | None) -> Callable[[str, dict], dict]:
    """A transport by ``module:function``."""
    if not path:
        return http_json
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def comment_bodies(node: dict) -> Iterator[str]:
    """Texts of a comment tree, top first; bots and deleted authors go, their replies stay."""
    stack = [node]
    while stack:
        at = stack.pop()
        data = at.get("data", at)
        if data.get("body") and str(data.get("author", "")).lower() not in SKIPPED_AUTHORS:
            yield data["body"]
        replies = data.get("replies") or {}
        children = (replies.get("data", {}) if isinstance(replies, dict) else {}).get("children", []) or data.get("children", [])
        stack.extend(c for c in reversed(children) if isinstance(c, dict))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.get = None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.options.get("items", "").split("|") if x] or [InputPartition("")]


class _ForumReader(_Reader):
    """Topics of a forum: pages until enough topics, no further link, or the page limit."""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get, base, want = transport(self.options.get("transport")), self.options["url"], int(self.options.get("want", "100"))
        seen = 0
        for page in range(MAX_PAGES):
            listing = get(f"{base}/latest.json", {"page": page, "order": self.options.get("order", "posts")}).get("topic_list", {})
            for topic in listing.get("topics", []):
                posts = get(f"{base}/t/{topic['id']}.json", {}).get("post_stream", {}).get("posts", [])
                texts = [p.get("cooked") or "" for p in posts if str(p.get("username", "")).lower() not in SKIPPED_POSTERS]
                yield (int(topic["id"]), topic.get("title"), texts)
                seen += 1
                if seen >= want:
                    return
            if not listing.get("more_topics_url"):
                return


class ForumSource(DataSource):
    """``spark.read.format("forum").option("url", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "forum"

    def schema(self) -> str:
        return "topic_id bigint, title string, posts array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _ForumReader(dict(self.options))


class _ThreadReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get, base = transport(self.options.get("transport")), self.options["url"]
        for child in get(f"{base}/{partition.value}/top.json", {"limit": int(self.options.get("limit", "25"))}).get("data", {}).get("children", []):
            d = child["data"]
            tree = get(f"{base}/comments/{d['id']}.json", {})
            bodies = [b for part in (tree if isinstance(tree, list) else [tree]) for b in comment_bodies(part)]
            yield (d["id"], partition.value, d.get("title"), bool(d.get("over_18")), int(d.get("num_comments", 0)), int(d.get("score", 0)), bodies)


class ThreadSource(DataSource):
    """``spark.read.format("threads").option("url", ...).option("items", "a|b")``, a partition for each board."""

    @classmethod
    def name(cls) -> str:
        return "threads"

    def schema(self) -> str:
        return "id string, board string, title string, nsfw boolean, comments int, score int, bodies array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _ThreadReader(dict(self.options))


class _ExtractReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        titles = [x for x in self.options.get("items", "").split("|") if x]
        return [InputPartition("|".join(titles[k : k + 10])) for k in range(0, len(titles), 10)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get = transport(self.options.get("transport"))
        pages = get(self.options["url"], {"action": "query", "prop": "extracts", "explaintext": 1, "format": "json", "titles": partition.value}).get("query", {}).get("pages", {})
        for page in pages.values():
            if page.get("extract"):
                yield (page.get("title"), page["extract"])


class ExtractSource(DataSource):
    """Encyclopedia extracts, ten titles to a request and partition."""

    @classmethod
    def name(cls) -> str:
        return "extracts"

    def schema(self) -> str:
        return "title string, extract string"

    def reader(self, schema) -> DataSourceReader:
        return _ExtractReader(dict(self.options))


def continued(get: Callable[[str, dict], dict], url: str, params: dict, token: str, pages: int) -> Iterator[dict]:
    """Answers of a paged action API: each names where the next one begins, at most ``pages`` of them."""
    more: dict = {}
    for _ in range(pages):
        answer = get(url, {**params, **more, "format": "json"}) or {}
        yield answer
        at = answer.get("continue", {}).get(token)
        if not at:
            return
        more = {token: at}


class _TitleReader(_Reader):
    """Titles of categories (a partition each), of a search, or at random."""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, get = self.options, transport(self.options.get("transport"))
        kind, limit = o.get("kind", "category"), int(o.get("limit", "50"))
        if kind == "random":
            params, token, pages = {"list": "random", "rnnamespace": 0, "rnlimit": limit}, "rncontinue", 1
        elif kind == "search":
            params, token, pages = {"list": "search", "srsearch": partition.value, "srlimit": limit}, "sroffset", 1
        else:
            params = {"list": "categorymembers", "cmtitle": partition.value, "cmlimit": limit, **({"cmtype": "page"} if o.get("works") else {"cmnamespace": 0})}
            token, pages = "cmcontinue", int(o.get("pages", "6"))
        for answer in continued(get, o["url"], {"action": "query", **params}, token, pages):
            for page in answer.get("query", {}).get(params["list"], []):
                yield (partition.value, page["title"])


class TitleSource(DataSource):
    """``spark.read.format("titles").option("kind", "category" | "search" | "random").option("items", "a|b")``."""

    @classmethod
    def name(cls) -> str:
        return "titles"

    def schema(self) -> str:
        return "item string, title string"

    def reader(self, schema) -> DataSourceReader:
        return _TitleReader(dict(self.options))


class _SummaryReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        data = transport(self.options.get("transport"))(f"{self.options['url']}/{partition.value.replace(' ', '_')}", {}) or {}
        ambiguous = self.options.get("ambiguous", "anlam ayrımı") in (data.get("description") or "").lower()
        yield (partition.value, data.get("title") or partition.value, None if ambiguous else data.get("extract"))


class SummarySource(DataSource):
    """Page summaries, one request and partition for each title; a page that only lists meanings has none."""

    @classmethod
    def name(cls) -> str:
        return "summaries"

    def schema(self) -> str:
        return "item string, title string, summary string"

    def reader(self, schema) -> DataSourceReader:
        return _SummaryReader(dict(self.options))


class _WikitextReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        params = {"action": "query", "prop": "revisions", "rvprop": "content", "rvslots": "main", "titles": partition.value, "redirects": 1, "format": "json"}
        pages = transport(self.options.get("transport"))(self.options["url"], params).get("query", {}).get("pages", {})
        text = next((p["revisions"][0]["slots"]["main"]["*"] for p in pages.values() if p.get("revisions")), "")
        yield (partition.value, text)


class WikitextSource(DataSource):
    """The wiki text of works, one request and partition for each title."""

    @classmethod
    def name(cls) -> str:
        return "wikitext"

    def schema(self) -> str:
        return "title string, wikitext string"

    def reader(self, schema) -> DataSourceReader:
        return _WikitextReader(dict(self.options))


def resolve_category(names: list[str], wanted: str, key: Callable[[str], str]) -> str | None:
    """Of category names the one with the wanted key, else the first of which one begins with the other's key."""
    q = key(wanted)
    if not q:
        return None
    same = next((n for n in names if key(n) == q), None)
    return same or next((n for n in names if len(key(n)) > 3 and (key(n).startswith(q) or q.startswith(key(n)))), None)


def patient_json(url: str, params: dict, retries: int = 6, sleep: Callable[[float], None] = time.sleep, get: Callable[[str, dict], dict] | None = None) -> dict:
    """GET with waits of 5 * 2**k + 1 seconds after 429 and server errors; other client errors are raised at once."""
    ask = get or (lambda u, p: http_json(u, p, retries=0))
    for attempt in range(retries):
        try:
            return ask(url, params)
        except OSError as failed:
            code = getattr(failed, "code", 0)
            if attempt + 1 == retries or (code and code != 429 and code < 500):
                raise
            sleep(5 * 2**attempt + 1 if code else 2 * (attempt + 1))
    return {}


def register(spark) -> None:
    for source in (ForumSource, ThreadSource, ExtractSource, TitleSource, SummarySource, WikitextSource):
        spark.dataSource.register(source)
