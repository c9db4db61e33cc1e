"""Results of external search engines: pages and JSON into rows."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.html import Node, once, pieces, tree

RESULT = "array<struct<title:string,url:string,content:string,position:int,engine:string,publishedDate:string>>"


# fixed values: titles of pages that refuse, and the link form of the headline engine
_REFUSED_SEARCH = re.compile(r"(?i)captcha|access denied|too many requests|rate limit|forbidden")
_REFUSED_NEWS = re.compile(r"(?i)just a moment|access denied|captcha|too many requests")
_NOTHING = re.compile(r"No articles were found matching .+ in the headline\. Please try searching again\.")


def _words(n: Node | None) -> str:
    return " ".join(n.text().split()) if n else ""


def _above(n: Node):
    while n:
        yield n
        n = n.parent


def _unseen(n: Node) -> bool:
    return any("hidden" in x.attrs or x.attrs.get("aria-hidden") == "true" for x in _above(n))


def _of_class(root: Node, name: str) -> list[Node]:
    return [n for n in root.walk() if name in n.attrs.get("class", "").split()]


def outside_url(href: str, own_host: str, known=urls.BUILT_IN) -> str | None:
    """The canonical form of a result's link: http(s), no user in it, not the engine itself, valid."""
    href = "https:" + href if href.startswith("//") else href
    authority = re.match(r"(?i)https?://([^/?#]*)", href)
    if not authority or "@" in authority.group(1):
        return None
    url = urls.parse(href)
    if url.host == own_host or url.host.endswith("." + own_host):
        return None
    return str(url) if urls.is_valid(href, known) else None


def _outcome(root: Node, found: list[dict], refused: re.Pattern) -> tuple[str, list[dict]]:
    if found:
        return "ok", found
    title = _words(next(iter(root.find("title")), None))
    return ("blocked" if refused.search(title) else "parse_error"), []


def search_results(markup: str, engine: str, own_host: str, limit: int = 10, known=urls.BUILT_IN) -> tuple[str, list[dict]]:
    """status and results of a page whose results are links in second-level headings of the main part."""
    root, found, seen = tree(markup), [], set()
    for main in root.find("main"):
        for a in (k for h in main.find("h2") for k in h.kids if isinstance(k, Node) and k.tag == "a" and "href" in k.attrs):
            url, title = outside_url(a.attrs["href"], own_host, known), _words(a)
            if len(found) == limit or url is None or not title or url in seen or _unseen(a):
                continue
            seen.add(url)
            card = next((x for x in _above(a.parent) if x.tag == "div" and x.find("p")), None)
            alone = card is not None and sum(isinstance(k, Node) and k.tag == "a" for h in card.find("h2") for k in h.kids) == 1
            found.append({"title": title, "url": url, "content": _words(card.find("p")[0]) if alone else "", "position": len(found) + 1, "engine": engine, "publishedDate": None})
    return _outcome(root, found, _REFUSED_SEARCH)


def headline_results(markup: str, engine: str, link: str, limit: int = 10) -> tuple[str, list[dict]]:
    """status and results of a page of headline cards; ``link`` is the pattern of a result's URL."""
    root, found, seen = tree(markup), [], set()
    for card in (n for n in _of_class(root, "article-card") if n.tag == "article"):
        section = next((x for x in _above(card) if x.tag == "section"), None)
        heading = next((k for h in section.find("h2") for k in h.kids if isinstance(k, Node) and k.tag == "a"), None) if section else None
        a = next((n for n in _of_class(card, "article-card__headline") if n.tag == "a"), None)
        if len(found) == limit or _unseen(card) or heading and "searchheadlines=1" not in heading.attrs.get("href", "") or not a:
            continue
        url, title = a.attrs.get("href", ""), _words(a)
        if not re.fullmatch(link, url) or url in seen or not title:
            continue
        seen.add(url)
        publisher = _words(next(iter(_of_class(card, "article-publisher__name")), None))
        time = next((n for n in card.walk() if "data-timestamp" in n.attrs), None)
        stamp = time.attrs["data-timestamp"] if time else ""
        date = datetime.datetime.fromtimestamp(int(stamp), datetime.UTC).isoformat() if re.fullmatch("[0-9]+", stamp) else ""
        found.append({"title": title, "url": url, "content": f"{publisher} {_words(time)}".strip(), "position": len(found) + 1, "engine": engine, "publishedDate": date})
    status, rows = _outcome(root, found, _REFUSED_NEWS)
    title = _words(next(iter(root.find("title")), None))
    if status == "parse_error" and " headlines |" in title and any(_NOTHING.fullmatch(_words(n)) for n in root.walk()):
        status = "no_results"
    return status, rows


def _parsed(markup: Column, parse) -> Column:
    @F.pandas_udf(f"status string, results {RESULT}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            for at in pieces(s):
                yield pd.DataFrame([parse(m or "") for m in s.iloc[at]], columns=["status", "results"])

    return once(run)(markup)


def search_page(markup: Column, engine: str, own_host: str, limit: int = 10, known=urls.BUILT_IN) -> Column:
    return _parsed(markup, lambda m: search_results(m, engine, own_host, limit, known))


def headline_page(markup: Column, engine: str, link: str, limit: int = 10) -> Column:
    return _parsed(markup, lambda m: headline_results(m, engine, link, limit))


def encyclopedia(body: Column, host: str) -> Column:
    """JSON {"pages": [{title, key, excerpt}]} of an encyclopedia into the same rows; tags go, entities are decoded."""
    pages = F.from_json(body, "pages array<struct<title:string,key:string,excerpt:string>>")["pages"]
    plain = lambda x: entities(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", ""))
    return F.transform(pages, lambda p, i: F.struct(p["title"].alias("title"), F.concat(F.lit(f"https://{host}/wiki/"), p["key"]).alias("url"), plain(p["excerpt"]).alias("content"), (i + 1).alias("position")))


def entities(c: Column) -> Column:
    """The named entities that JSON excerpts hold, and decimal ones, as characters."""
    for name, sign in (("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def engine_url(c: Column, host: str) -> Column:
    """Whether a URL is the engine's own: https, nobody in front of the host, the standard port, the host or below it."""
    authority = F.regexp_extract(c, r"^(?i:https)://([^/?#]*)", 1)
    name = F.lower(F.regexp_replace(authority, r":443$|:$", ""))
    return F.coalesce((authority != "") & ~authority.contains("@") & ((name == host) | name.endswith("." + host)), F.lit(False))
