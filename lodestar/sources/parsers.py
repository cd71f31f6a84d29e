"""Payloads to result rows, one parser for each source.

A parser takes payloads (request_id, body, ...) and returns request_id, ``_seq`` (place in the
payload), title, url, snippet, published, kind. A payload that is not the source's envelope gives
one row with kind ``parse``; an empty envelope gives none. JSON sources stay inside the engine.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.udf import rowwise
from lodestar import html as H
from lodestar.functions import text as T
from lodestar.functions import timefn, web

ROW = "title string, url string, snippet string, published string"
DEPTH_MOST, ENTRIES_MOST = 1500, 1000
Made = dict[str, Column]


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _from_json(payloads: DataFrame, schema: str, items: Callable[[Column], Column], row: Callable[[Column, Column], Made], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Explode the array that ``items`` finds in the envelope; null there means a parse failure."""
    doc = payloads.withColumn("_doc", F.from_json("body", schema))
    found = doc.withColumn("_items", items(F.col("_doc")))
    rows = found.select("request_id", "_doc", F.col("_items").isNull().alias("_bad"), F.posexplode_outer("_items").alias("_pos", "_it"))
    it, own = F.col("_it"), F.col("_doc")
    made = row(it, own)
    fine = it.isNotNull() if keep is None else it.isNotNull() & F.coalesce(keep(it), F.lit(False))
    fine = fine & made["title"].isNotNull() & made["url"].isNotNull()
    return rows.where(F.col("_bad") | fine).select(
        "request_id", F.coalesce(F.col("_pos") + 1, F.lit(0)).cast("bigint").alias("_seq"),
        *(F.when(~F.col("_bad"), made[c]).alias(c) for c in ("title", "url", "snippet")),
        F.when(~F.col("_bad"), made["published"]).alias("published"), F.when(F.col("_bad"), "parse").alias("kind"),
    )


def _made(title: Column, url: Column, *meta: Column, published: Column | None = None) -> Made:
    return {"title": title, "url": url, "snippet": T.snippet(T.join_meta(*meta)), "published": published if published is not None else F.lit(None).cast("timestamp")}


def wikipedia(payloads: DataFrame, lang: str = "en") -> DataFrame:
    url = lambda it: F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), T.encode_path(F.replace(it["title"], F.lit(" "), F.lit("_"))))
    return _from_json(
        payloads, "query struct<search:array<struct<title:string,snippet:string>>>", lambda d: d["query"]["search"],
        lambda it, _: _made(it["title"], url(it), T.strip_html(_s(it["snippet"]))),
    )


def hackernews(payloads: DataFrame) -> DataFrame:
    full = lambda c: F.nullif(c, F.lit(""))
    return _from_json(
        payloads, "hits array<struct<objectID:string,title:string,story_title:string,url:string,points:bigint,num_comments:bigint,author:string,created_at_i:bigint>>", lambda d: d["hits"],
        lambda it, _: _made(
            T.snippet(F.coalesce(full(it["title"]), full(it["story_title"]))),
            F.coalesce(full(it["url"]), F.concat(F.lit("https://news.ycombinator.com/item?id="), it["objectID"])),
            F.concat(F.coalesce(it["points"], F.lit(0)), F.lit(" points")), F.concat(F.coalesce(it["num_comments"], F.lit(0)), F.lit(" comments")),
            F.concat(F.lit("by "), F.coalesce(it["author"], F.lit("?"))), published=timefn.unix(it["created_at_i"]),
        ),
    )


def hackernews_filters(since: int | None, until: int | None) -> str:
    """The bounds that this source takes itself."""
    return ",".join(([f"created_at_i>={since}"] if since is not None else []) + ([f"created_at_i<{until}"] if until is not None else []))


def social(payloads: DataFrame) -> DataFrame:
    """Posts; the mirrored status in ``code`` decides before any row is read."""
    count = lambda c, name: F.concat(F.greatest(F.coalesce(c, F.lit(0.0)).cast("bigint"), F.lit(0)), F.lit(f" {name}"))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    schema = "code double, results array<struct<id:string,url:string,text:string,created_at:string,likes:double,reposts:double,replies:double,author:struct<name:string,screen_name:string>>>"
    code = F.from_json("body", "code double")["code"].cast("int")
    kind = F.when(code.isin(202, 429), "rate_limited").when(~code.between(200, 299), "http")
    failed = payloads.withColumn("_kind", kind).where("_kind is not null")
    rows = _from_json(
        payloads.where(kind.isNull()), schema, lambda d: d["results"],
        lambda it, _: _made(
            T.snippet(F.concat(F.lit("@"), F.coalesce(full(it["author"]["screen_name"]), full(it["author"]["name"]), F.lit("unknown")))),
            F.coalesce(web.http_url(it["url"]), F.when(F.trim(it["id"]).rlike(r"^\d{2,20}$"), F.concat(F.lit("https://x.com/i/status/"), F.trim(it["id"])))),
            it["text"], count(it["likes"], "likes"), count(it["reposts"], "reposts"), count(it["replies"], "replies"), published=timefn.social(it["created_at"]),
        ),
    )
    none = F.lit(None).cast("string")
    return rows.unionByName(
        failed.select("request_id", F.lit(0).cast("bigint").alias("_seq"), none.alias("title"), none.alias("url"), none.alias("snippet"), F.lit(None).cast("timestamp").alias("published"), F.col("_kind").alias("kind"))
    )


def stackexchange(payloads: DataFrame) -> DataFrame:
    tags = lambda it: F.when(F.size(it["tags"]) > 0, F.concat(F.lit("["), F.array_join(it["tags"], ", "), F.lit("]"))).otherwise("")
    return _from_json(
        payloads, "items array<struct<title:string,link:string,tags:array<string>,score:bigint,answer_count:bigint,is_answered:boolean,creation_date:bigint>>", lambda d: d["items"],
        lambda it, _: _made(
            T.snippet(F.when(it["title"].contains("&"), T.unescape_entities(it["title"])).otherwise(it["title"])), it["link"], tags(it), F.concat(F.lit("score "), F.coalesce(it["score"], F.lit(0))),
            F.concat(F.coalesce(it["answer_count"], F.lit(0)), F.when(it["is_answered"], " answers ✓").otherwise(" answers –")), published=timefn.unix(it["creation_date"]),
        ),
        keep=lambda it: F.coalesce(it["link"], F.lit("")) != "",
    )


def openalex(payloads: DataFrame) -> DataFrame:
    return _from_json(
        payloads, "results array<struct<id:string,doi:string,display_name:string,title:string,publication_year:bigint,publication_date:string,cited_by_count:bigint,primary_location:struct<source:struct<display_name:string>>>>", lambda d: d["results"],
        lambda it, _: _made(
            T.snippet(T.strip_html(F.coalesce(it["display_name"], it["title"]))), F.coalesce(it["doi"], it["id"]), _s(it["publication_year"]), _s(it["primary_location"]["source"]["display_name"]),
            F.coalesce(F.concat(F.lit("cited "), it["cited_by_count"]), F.lit("")),
            published=F.coalesce(timefn.iso(it["publication_date"]), F.when(it["publication_year"].isNotNull(), timefn.date_parts(F.array(it["publication_year"])))),
        ),
    )


def crossref(payloads: DataFrame) -> DataFrame:
    parts = lambda it: F.get(it["published"]["date-parts"], F.lit(0))
    year = lambda it: F.get(parts(it), F.lit(0))
    return _from_json(
        payloads, "message struct<items:array<struct<DOI:string,title:array<string>,URL:string,`container-title`:array<string>,published:struct<`date-parts`:array<array<bigint>>>,`is-referenced-by-count`:bigint>>>", lambda d: d["message"]["items"],
        lambda it, _: _made(
            T.snippet(T.strip_html(F.get(it["title"], F.lit(0)))), F.coalesce(it["URL"], F.concat(F.lit("https://doi.org/"), it["DOI"])), _s(F.get(it["container-title"], F.lit(0))),
            F.when(year(it) > 0, year(it).cast("string")).otherwise(""), F.concat(F.lit("cited "), F.coalesce(it["is-referenced-by-count"], F.lit(0))), published=timefn.date_parts(parts(it)),
        ),
    )


def pubmed(payloads: DataFrame) -> DataFrame:
    """``payloads``: request_id, ids (the search's JSON), body (the summaries' JSON). Rows keep the order
    of the ids; ids without a summary are skipped, and if none has one that is a parse failure."""
    docs = F.map_filter(F.from_json("body", "result map<string,string>")["result"], lambda k, _: k != "uids")
    one = "title string, source string, pubdate string"
    found = payloads.withColumn("_docs", docs).withColumn("_ids", F.from_json("ids", "esearchresult struct<idlist:array<string>,ERROR:string>")["esearchresult"])
    found = found.withColumn("_hits", F.filter(F.transform("_ids.idlist", lambda i: F.struct(i.alias("id"), F.from_json(F.try_element_at(F.col("_docs"), i), one).alias("d"))), lambda x: x["d"]["title"].isNotNull()))
    bad = F.col("_docs").isNull() | F.col("_ids").isNull() | F.col("_ids.ERROR").isNotNull() | F.col("_ids.idlist").isNull() | ((F.size("_hits") == 0) & (F.size("_ids.idlist") > 0))
    rows = found.withColumn("_bad", F.coalesce(bad, F.lit(True))).select("request_id", "_bad", F.posexplode_outer("_hits").alias("_pos", "_it"))
    it = F.col("_it.d")
    good = ~F.col("_bad") & F.col("_it").isNotNull()
    return rows.where(good | (F.col("_bad") & (F.coalesce("_pos", F.lit(0)) == 0))).select(
        "request_id", F.when(good, F.col("_pos") + 1).otherwise(0).cast("bigint").alias("_seq"),
        F.when(good, T.snippet(T.strip_html(it["title"]))).alias("title"), F.when(good, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("_it.id"), F.lit("/"))).alias("url"),
        F.when(good, T.snippet(T.join_meta(it["source"], it["pubdate"]))).alias("snippet"), F.when(good, timefn.pubmed(it["pubdate"])).alias("published"), F.when(F.col("_bad"), "parse").alias("kind"),
    )


def crates(payloads: DataFrame) -> DataFrame:
    return _from_json(
        payloads, "crates array<struct<id:string,description:string,downloads:bigint,repository:string,documentation:string,max_version:string,updated_at:string>>", lambda d: d["crates"],
        lambda it, _: _made(
            it["id"], F.coalesce(F.nullif(it["repository"], F.lit("")), it["documentation"], F.concat(F.lit("https://crates.io/crates/"), it["id"])), _s(it["description"]),
            F.concat(F.lit("v"), it["max_version"]), F.concat(F.coalesce(it["downloads"], F.lit(0)), F.lit(" downloads")), published=timefn.iso(it["updated_at"]),
        ),
    )


def npm(payloads: DataFrame) -> DataFrame:
    return _from_json(
        payloads, "objects array<struct<package:struct<name:string,version:string,description:string,links:struct<npm:string>,date:string>,downloads:struct<monthly:bigint>>>", lambda d: d["objects"],
        lambda it, _: _made(
            it["package"]["name"], F.coalesce(it["package"]["links"]["npm"], F.concat(F.lit("https://www.npmjs.com/package/"), it["package"]["name"])), _s(it["package"]["description"]),
            F.concat(F.lit("v"), it["package"]["version"]), F.concat(F.coalesce(it["downloads"]["monthly"], F.lit(0)), F.lit(" downloads/mo")), published=timefn.iso(it["package"]["date"]),
        ),
    )


def pypi(payloads: DataFrame) -> DataFrame:
    """``payloads`` also has ``name``, the package asked for. The date is the latest upload of any release."""
    latest = lambda d: F.array_max(F.transform(F.flatten(F.map_values(d["releases"])), lambda f: f["upload_time_iso_8601"]))
    schema = "info struct<name:string,summary:string,version:string,package_url:string,home_page:string>, releases map<string,array<struct<upload_time_iso_8601:string>>>"
    doc = payloads.withColumn("_doc", F.from_json("body", schema))
    info, bad = F.col("_doc.info"), F.col("_doc.info").isNull()
    full = lambda c: F.nullif(c, F.lit(""))
    return doc.select(
        "request_id", F.when(bad, 0).otherwise(1).cast("bigint").alias("_seq"), F.when(~bad, F.coalesce(full(info["name"]), F.col("name"))).alias("title"),
        F.when(~bad, F.coalesce(full(info["package_url"]), info["home_page"], F.concat(F.lit("https://pypi.org/project/"), T.encode_path(F.col("name"), keep_slashes=False), F.lit("/")))).alias("url"),
        F.when(~bad, T.snippet(T.join_meta(info["summary"], F.concat(F.lit("v"), info["version"])))).alias("snippet"),
        F.when(~bad, timefn.iso(latest(F.col("_doc")))).alias("published"), F.when(bad, "parse").alias("kind"),
    )


def nominatim(payloads: DataFrame) -> DataFrame:
    coords = lambda it: F.when((_s(it["lat"]) == "") & (_s(it["lon"]) == ""), "").otherwise(F.concat(_s(it["lat"]), F.lit(","), _s(it["lon"])))
    return _from_json(
        payloads, "array<struct<display_name:string,osm_type:string,osm_id:bigint,type:string,lat:string,lon:string>>", lambda d: d,
        lambda it, _: _made(
            T.snippet(F.coalesce(F.nullif(it["display_name"], F.lit("")), _s(it["type"]))), F.concat(F.lit("https://www.openstreetmap.org/"), _s(it["osm_type"]), F.lit("/"), F.coalesce(it["osm_id"], F.lit(0))), _s(it["type"]), coords(it)
        ),
    )


def images_json(payloads: DataFrame) -> DataFrame:
    """(request_id, _seq, title, url, page_url, width, height, format); sizes out of range are null."""
    doc = payloads.withColumn("_doc", F.from_json("body", "results array<struct<image:string,title:string,url:string,width:bigint,height:bigint>>"))
    rows = doc.select("request_id", F.posexplode("_doc.results").alias("_pos", "it"))
    return _image_rows(rows, "it.title", "it.image", "it.url", "it.width", "it.height")


def _image_rows(rows: DataFrame, title: str, url: str, page: str, width: str, height: str) -> DataFrame:
    size = lambda c: F.when(F.col(c).between(0, 4294967295), F.col(c))
    image = web.http_url(F.col(url))
    return rows.where(image.isNotNull()).select(
        "request_id", (F.col("_pos") + 1).cast("bigint").alias("_seq"), T.snippet(F.coalesce(F.col(title), F.lit(""))).alias("title"), image.alias("url"),
        F.coalesce(web.http_url(F.col(page)), F.lit("")).alias("page_url"), size(width).alias("width"), size(height).alias("height"), web.image_format(image).alias("format"),
    )


def token(body: Column | str, name: str = "vqd") -> Column:
    """The token that a search page hands out for its JSON endpoint."""
    return F.nullif(F.regexp_extract(T.col(body), rf"""{name}=["']?([\d-]+)""", 1), F.lit(""))


@rowwise("array<struct<m:string,alt:string>>")
def _image_attrs(body: str | None) -> list[dict]:
    found = []
    for n in H.tree(body or "").walk():
        if n.tag == "a" and n.has_class("iusc") and "m" in n.attrs:
            found.append({"m": n.attrs["m"], "alt": next((x.attrs.get("alt", "") for x in n.walk() if x.tag == "img"), "")})
    return found


def images_attr(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("request_id", F.posexplode(_image_attrs("body")).alias("_pos", "_a"))
    rows = rows.withColumn("it", F.from_json("_a.m", "murl string, purl string, murlw bigint, murlh bigint, t string"))
    return _image_rows(rows.withColumn("_title", F.coalesce(F.nullif("it.t", F.lit("")), "_a.alt")), "_title", "it.murl", "it.purl", "it.murlw", "it.murlh")


FEED = "array<struct<title:string,link:string,summary:string,author:string,category:string,published:string>>"


class _Shallow(ET.TreeBuilder):
    """A tree that refuses to nest deeper than DEPTH_MOST."""

    depth = 0

    def start(self, tag: str, attrs: dict) -> ET.Element:
        self.depth += 1
        if self.depth > DEPTH_MOST:
            raise ET.ParseError("nested too deep")
        return super().start(tag, attrs)

    def end(self, tag: str) -> ET.Element:
        self.depth -= 1
        return super().end(tag)


def feed_entries(body: str) -> list[dict] | None:
    """Entries of an RSS or Atom document, by local names; None if it is neither or nests too deep."""
    try:
        root = ET.fromstring(body.strip(), ET.XMLParser(target=_Shallow()))  # noqa: S314  entities are not resolved
    except (ET.ParseError, RecursionError):
        return None
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    if local(root) not in ("rss", "feed", "RDF"):
        return None
    out = []
    names = {"title": "title", "summary": "summary", "content": "summary", "description": "summary", "encoded": "summary", "pubDate": "published", "published": "published", "updated": "published", "date": "published", "creator": "author"}
    for e in root.iter():
        if local(e) not in ("item", "entry"):
            continue
        row = dict.fromkeys(("title", "link", "summary", "author", "category", "published"), "")
        for c in e:
            name, text = local(c), "".join(c.itertext()).strip()
            if name == "link":
                if not row["link"] and c.get("rel", "alternate") == "alternate":
                    row["link"] = (c.get("href") or text).strip()
            elif name == "author":
                row["author"] = row["author"] or next(("".join(n.itertext()).strip() for n in c if local(n) == "name"), text)
            elif name == "category":
                row["category"] = row["category"] or (c.get("label") or c.get("term") or text).strip()
            elif name in names:
                row[names[name]] = row[names[name]] or text
        out.append(row)
        if len(out) == ENTRIES_MOST:
            break
    return out


@rowwise(FEED)
def _feed(body: str | None) -> list[dict] | None:
    return feed_entries(body or "")


def feed(payloads: DataFrame, join: Callable[..., Column] = T.join_meta) -> DataFrame:
    """Posts of an Atom or RSS feed: category, author and stripped summary make the snippet, put together by ``join``."""
    rows = payloads.select("request_id", _feed("body").alias("_items")).select("request_id", F.col("_items").isNull().alias("_bad"), F.posexplode_outer("_items").alias("_pos", "_it"))
    it, url = F.col("_it"), web.http_url(F.col("_it.link"))
    author = F.when(it["author"] == "", "").otherwise(F.concat(F.lit("by "), it["author"]))
    return _rows(rows, it["title"], url, T.snippet(join(it["category"], author, T.strip_html(it["summary"]))), timefn.feed_date(it["published"]))


def web_rss(payloads: DataFrame) -> DataFrame:
    """Web results as RSS: tracking links are decoded, descriptions stripped."""
    rows = payloads.select("request_id", _feed("body").alias("_items")).select("request_id", F.col("_items").isNull().alias("_bad"), F.posexplode_outer("_items").alias("_pos", "_it"))
    it = F.col("_it")
    url = F.coalesce(web.decode_redirect_b64(it["link"]), web.http_url(it["link"]))
    return _rows(rows, T.snippet(T.strip_html(it["title"])), url, T.snippet(T.strip_html(it["summary"])), timefn.feed_date(it["published"]))


def _rows(rows: DataFrame, title: Column, url: Column, snippet: Column, published: Column) -> DataFrame:
    good = ~F.col("_bad") & F.col("_it").isNotNull() & url.isNotNull() & (title != "")
    return rows.where(F.col("_bad") | good).select(
        "request_id", F.coalesce(F.col("_pos") + 1, F.lit(0)).cast("bigint").alias("_seq"), F.when(good, title).alias("title"), F.when(good, url).alias("url"),
        F.when(good, snippet).alias("snippet"), F.when(good, published).alias("published"), F.when(F.col("_bad"), "parse").alias("kind"),
    )


SELECTED = "array<struct<title:string,link:string,summary:string>>"


def _is_ad(node: H.Node) -> bool:
    return any(c == "ad" or c.endswith("--ad") or c.startswith("result--ad") for c in node.attrs.get("class", "").split())


def ddg_results(body: str) -> list[dict]:
    out = []
    for n in H.tree(body).walk():
        if not n.has_class("result") or _is_ad(n):
            continue
        link = next((x for x in n.walk() if x.tag == "a" and x.has_class("result__a")), None)
        if link is not None:
            said = next((x.text() for x in n.walk() if x.has_class("result__snippet")), "")
            out.append({"title": " ".join(link.text().split()), "link": link.attrs.get("href", ""), "summary": said})
    return out


def bing_results(body: str) -> list[dict]:
    out = []
    for n in H.tree(body).walk():
        if n.tag != "li" or not n.has_class("b_algo"):
            continue
        head = next((x for x in n.walk() if x.tag == "h2"), None)
        link = next((x for x in head.walk() if x.tag == "a"), None) if head else None
        if link is not None:
            said = next((x.text() for x in n.walk() if x.tag == "p" or x.has_class("b_lineclamp2")), "")
            out.append({"title": " ".join(link.text().split()), "link": link.attrs.get("href", ""), "summary": said})
    return out


@rowwise(SELECTED)
def _ddg(body: str | None) -> list[dict]:
    return ddg_results(body or "")


@rowwise(SELECTED)
def _bing(body: str | None) -> list[dict]:
    return bing_results(body or "")


def _scraped(payloads: DataFrame, items: Column, unwrap: Callable[[Column], Column]) -> DataFrame:
    """Result pages: a page that asks for a human is rate limiting, not an empty answer."""
    asks = web.is_challenge("body")
    rows = payloads.where(~asks).select("request_id", F.lit(False).alias("_bad"), F.posexplode(items).alias("_pos", "_it"))
    it = F.col("_it")
    found = _rows(rows, it["title"], F.coalesce(unwrap(it["link"]), web.http_url(it["link"])), T.snippet(it["summary"]), F.lit(None).cast("timestamp"))
    none = F.lit(None).cast("string")
    held = payloads.where(asks).select("request_id", F.lit(0).cast("bigint").alias("_seq"), none.alias("title"), none.alias("url"), none.alias("snippet"), F.lit(None).cast("timestamp").alias("published"), F.lit("rate_limited").alias("kind"))
    return found.unionByName(held)


def ddg_html(payloads: DataFrame) -> DataFrame:
    return _scraped(payloads, _ddg("body"), web.unwrap_redirect)


def bing_html(payloads: DataFrame) -> DataFrame:
    return _scraped(payloads, _bing("body"), web.decode_redirect_b64)


def channel_posts(body: str) -> dict:
    posts, ids = [], []
    root = H.tree(body)
    first = lambda node, name, tag=None: next((x for x in node.walk() if x.has_class(name) and (tag is None or x.tag == tag)), None)
    for wrap in root.walk():
        if wrap.tag != "div" or not wrap.has_class("tgme_widget_message_wrap"):
            continue
        inner = first(wrap, "tgme_widget_message")
        ref = wrap.attrs.get("data-post") or (inner.attrs.get("data-post") if inner else None) or ""
        m = re.fullmatch(r"([^/]+)/(.*)", ref, re.S)
        if not m:
            continue
        number = int(m[2]) if re.fullmatch(r"[0-9]{1,18}", m[2], re.A) else None
        if number is not None:
            ids.append(number)
        date = first(wrap, "tgme_widget_message_date", "a")
        clock = next((x for x in date.walk() if x.tag == "time"), None) if date else None
        text, views = first(wrap, "tgme_widget_message_text"), first(wrap, "tgme_widget_message_views")
        posts.append(
            {
                "url": date.attrs.get("href") if date else None, "post_channel": m[1], "post_id": number,
                "published": (clock.attrs.get("datetime") if clock else None) or (date.attrs.get("datetime") if date else None),
                "text": text.text().strip() if text else "", "views": views.text().strip() if views else "",
            }
        )
    return {"posts": posts, "oldest": min(ids, default=None), "has_channel": first(root, "tgme_channel_info_header") is not None}


@rowwise("posts array<struct<url:string,post_channel:string,post_id:bigint,published:string,text:string,views:string>>, oldest bigint, has_channel boolean")
def channel_page(body: str | None) -> dict:
    return channel_posts(body or "")


def _post(base: str, join: Callable[..., Column] = T.join_meta) -> Made:
    """The parts of a row made of a post ``_it`` of ``channel``."""
    it = F.col("_it")
    url = F.coalesce(web.http_url(it["url"]), F.concat(F.lit(base.rstrip("/") + "/"), T.encode_path(it["post_channel"], keep_slashes=False), F.lit("/"), it["post_id"]))
    seen = F.when(it["views"] == "", "").otherwise(F.concat(it["views"], F.lit(" views")))
    return {"title": F.concat(F.lit("@"), F.col("channel")), "url": url, "snippet": T.snippet(join(it["text"], seen)), "published": timefn.iso(it["published"])}


def channel(payloads: DataFrame, base: str = "https://t.me", join: Callable[..., Column] = T.join_meta) -> DataFrame:
    """Posts of channel pages. ``payloads`` also has ``channel``; ``oldest`` is the cursor of the page before.
    Text and views make the snippet, put together by ``join``."""
    rows = payloads.select("request_id", "channel", channel_page("body").alias("_page"))
    bad = (F.size("_page.posts") == 0) & ~F.col("_page.has_channel")
    rows = rows.select("request_id", "channel", bad.alias("_bad"), F.col("_page.oldest").alias("oldest"), F.posexplode_outer("_page.posts").alias("_pos", "_it"))
    return _rows(rows, *_post(base, join).values())


def posts(rows: DataFrame, base: str = "https://t.me") -> DataFrame:
    """Result rows of posts (request_id, channel, _seq, _it, kind); a row with a kind is a failure."""
    made = _post(base)
    good = F.col("kind").isNull() & made["url"].isNotNull()
    return rows.where(F.col("kind").isNotNull() | good).select("request_id", "_seq", *(F.when(good, c).alias(n) for n, c in made.items()), "kind")


def image_names(rows: DataFrame) -> DataFrame:
    """File names for downloads: place, cleaned title, extension."""
    ext = F.coalesce(F.nullif("format", F.lit("")), F.lit("img"))
    return rows.withColumn("file", F.concat(F.lpad(F.col("_seq").cast("string"), 4, "0"), F.lit("_"), T.sanitize_name("title"), F.lit("."), ext))


def download_plan(images: DataFrame, most_bytes: int = 5 * 1024 * 1024, limit: int = 50, overwrite: bool = False) -> DataFrame:
    """What to do with each fetched image (_seq, title, url, format, content, robots_allowed, on_disk):
    its file and ``skip``, the reason for not writing it. The name's extension is what the bytes say."""
    kind = web.sniff_image("content")
    skip = (
        F.when(F.col("_seq") > limit, "over_limit").when(web.egress_error("url").isNotNull(), "blocked_by_policy").when(~F.coalesce("robots_allowed", F.lit(True)), "robots")
        .when(F.octet_length("content") > most_bytes, "response_too_large").when(kind.isNull(), "unsupported_content_type")
    )
    named = image_names(images.withColumn("format", F.coalesce(kind, "format")))
    return named.withColumn("skip", skip if overwrite else skip.when(F.coalesce("on_disk", F.lit(False)), "exists"))


def bing(payloads: DataFrame) -> DataFrame:
    """A request's feed, or its result page if the feed has no rows or cannot be read.

    Payloads of one ``query`` belong together where there is such a column, else those of one request_id. A
    broken feed without a page stays a failure."""
    key = ["query"] if "query" in payloads.columns else ["request_id"]
    is_feed = F.coalesce(F.col("body").rlike(r"(?is)^\s*(<\?xml[^>]*>\s*)?<(rss|feed)\b"), F.lit(False))
    rss, pages = web_rss(payloads.where(is_feed)), payloads.where(~is_feed)
    request = payloads.select("request_id", *(F.col(k).alias("_of") for k in key)).distinct()
    told = rss.join(request, "request_id")
    answered = told.where("kind is null").select("_of").distinct()
    asked = pages.withColumn("_of", F.col(key[0])).join(answered, "_of", "left_anti")
    left = told.where("kind is not null").join(asked.select("_of").unionByName(answered), "_of", "left_anti")
    return told.where("kind is null").select(*rss.columns).unionByName(left.select(*rss.columns)).unionByName(bing_html(asked.drop("_of")))


PARSERS = {
    "duckduckgo": ddg_html, "bing": bing, "wikipedia": wikipedia, "hackernews": hackernews, "reddit": feed, "fxtwitter": social, "telegram": channel,
    "stackexchange": stackexchange, "openalex": openalex, "crossref": crossref, "pubmed": pubmed, "crates": crates, "npm": npm, "pypi": pypi, "nominatim": nominatim,
}
