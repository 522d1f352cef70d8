"""Documents: pages to text, HTML to article text, replies to records, and checks of paths, files and addresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.functions.markup import VOID, OpenElements, tokens
from docket.functions.text import blank_to_null, clean_text, strip
from docket.operators import schema as S

#: Elements that are dropped from pages, elements that hold text blocks.
DROPPED = {
    "script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript", "svg", "audio", "video",
    "button", "input", "textarea", "select", "option", "label", "dialog", "menu",
}
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li")
#: File categories by extension, limits of uploads.
CATEGORIES = {".pdf": "PDF", ".jpg": "Image", ".jpeg": "Image", ".png": "Image", ".csv": "CSV", ".xlsx": "Excel"}
MOST_BYTES = 50 * 1024 * 1024


def join_pages(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(key, text): non-empty pages in order, joined by an empty line."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page), F.col(text).alias("text"))))
    kept = F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: t != "")
    return pages.groupBy(key).agg(F.array_join(kept, "\n\n").alias("text"))


def has_text_layer(pages: Column, sample: int = 3, least: int = 50) -> Column:
    """Whether the first pages hold enough text for a document to count as digital."""
    return F.aggregate(F.slice(pages, 1, sample), F.lit(0), lambda a, p: a + F.length(strip(p))) >= least


def box_text(boxes: Column) -> Column:
    """(text, confidence) of OCR boxes (text, confidence): those that aren't blank, joined by spaces, and their mean."""
    kept = F.filter(boxes, lambda b: strip(b["text"]) != "")
    total = F.aggregate(kept, F.lit(0.0), lambda a, b: a + b["confidence"])
    mean = F.when(F.size(kept) > 0, total / F.size(kept))
    return F.struct(F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"), mean.alias("confidence"))


def apply_reader(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of binary files by an injected reader, e.g. of PDF pages or OCR. Runs in tasks, a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content):
                pages = reader(content)
                yield pd.DataFrame({"path": path, "page": range(len(pages)), "text": pages})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


ENDS_PARAGRAPH = frozenset((*BLOCKS, "div", "ul", "ol", "table", "section", "article", "main", "blockquote", "pre", "hr"))
ROOTS = ("article", "main", "body")


def article_text(page: str | None) -> str:
    """Text blocks of a page's first article, or else main, body, or the page.

    Paragraphs and list items end where browsers end them. A block within a block (a paragraph in a list item) gives its
    text to both, as each is a block of its own. Without blocks, all of the root's text is given.
    """
    texts: list[str] = []
    blocks: list[list[int]] = []  # first and last index in `texts`, in the order in which blocks begin
    roots: dict[str, list[int]] = {}  # first and last index in `texts`, then in `blocks`
    stack, dropped = OpenElements(), 0

    def end(at: int) -> None:
        nonlocal dropped
        for tag, block, root in stack.close(at):
            dropped -= tag in DROPPED
            if block is not None:
                block[1] = len(texts)
            if root is not None:
                root[1], root[3] = len(texts), len(blocks)

    for kind, x, _, _ in tokens(page or "", frozenset(("script", "style"))):
        if kind == "text":
            if not dropped:
                texts.append(x)
            continue
        if kind == "close":
            if (at := stack.last(x)) >= 0:
                end(at)
            continue
        if x in ENDS_PARAGRAPH and (at := stack.last("p")) >= 0:
            end(at)
        if x == "li" and (at := stack.last("li")) > stack.last("ul", "ol"):
            end(at)
        if x in VOID:
            continue
        root = block = None
        if not dropped and x in ROOTS and x not in roots:
            root = roots[x] = [len(texts), -1, len(blocks), -1]
        if not dropped and x in BLOCKS:
            block = [len(texts), -1]
            blocks.append(block)
        dropped += x in DROPPED
        stack.push(x, block, root)
    end(0)
    whole = [0, len(texts), 0, len(blocks)]
    first, last, head, tail = next((roots[r] for r in ROOTS if r in roots), whole)
    joined = [t for t in ("".join(texts[a:b]).strip() for a, b in blocks[head:tail]) if t]
    return "\n\n".join(joined) if joined else "".join(texts[first:last])


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(article_text)


def extract_pages(pages: DataFrame) -> DataFrame:
    """`pages` (url, html) with `text`, cleaned, and `error` where the address is bad or nothing is left."""
    text = clean_text(html_to_text(F.col("html")))
    return pages.withColumn("_bad", url_error(F.col("url"))).withColumn("text", text).withColumn(
        "error", F.coalesce("_bad", F.when(F.coalesce("text", F.lit("")) == "", F.lit("no text could be extracted")))
    ).drop("_bad")


def url_error(url: Column) -> Column:
    """What is wrong with an address, or null: it needs a scheme http or https and a host."""
    tidy = strip(url)
    scheme = F.lower(F.regexp_extract(tidy, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    host = F.regexp_extract(tidy, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return (
        F.when(F.coalesce(tidy, F.lit("")) == "", "empty address")
        .when((scheme == "") | (host == ""), "no scheme or host")
        .when(~scheme.isin("http", "https"), "scheme is not http or https")
    )


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def file_category(name: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, extension(name)), F.lit("Other"))


def upload_status(name: Column, size: Column) -> Column:
    """200, or 415 for an extension that isn't allowed, 400 for an empty file, 413 for one that is too large."""
    return (
        F.when(~extension(name).isin(*CATEGORIES), 415).when(size == 0, 400).when(size > MOST_BYTES, 413).otherwise(200)
    )


def reply_body(reply: Column) -> Column:
    """A reply without the marks of a fenced block around it."""
    body = F.regexp_replace(strip(reply), r"^```(?:json)?", "")
    return strip(F.regexp_replace(body, r"```$", ""))


def parse_reply(reply: Column, schema: T.StructType = S.RECORD) -> Column:
    """(record, error): error is 'empty', 'json' or 'schema' (a value, at any depth, has the wrong type), or null.

    The parser marks a record as corrupt when some value doesn't fit, so each reply is parsed twice: as JSON, and so.
    """
    body = blank_to_null(reply_body(reply))
    parsed = F.from_json(body, T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    whole = F.try_parse_json(body)
    error = F.when(body.isNull(), "empty").when(whole.isNull(), "json").when(parsed["_bad"].isNotNull(), "schema")
    record = F.struct(*(parsed[f.name].alias(f.name) for f in schema.fields))
    return F.struct(F.when(error.isNull(), record).alias("record"), error.alias("error"))
