"""Texts of queries, chunks, sources and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a keyword search leaves out.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "it", "its", "that", "this",
    "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may",
    "can", "you", "me", "my", "your", "who", "what", "how", "where",
    "when", "which", "give", "get", "tell", "show", "find", "please",
)
MAX_TERMS = 10
# Addresses and texts that answers show.
DOC_PREFIX = "doc://"
NO_SOURCES = "No sources available."
FALLBACK_URL, FALLBACK_TEXT = "local://weights", "Answer from model knowledge."


#: White space of any script, information separators too.
SPACE = r"(?U)[\s\x1c-\x1f]"


def stripped(c: Column) -> Column:
    """c without white space at its ends."""
    return F.regexp_replace(c, rf"^(?:{SPACE})+|(?:{SPACE})+\z", "")


def collapsed(c: Column) -> Column:
    """c with each stretch of white space as one space, none at its ends."""
    return F.trim(F.regexp_replace(c, f"(?:{SPACE})+", " "))


def normal_query(c: Column) -> Column:
    return F.lower(stripped(c))


def query_terms(c: Column) -> Column:
    """Lower-cased words of more than two characters that aren't stop words, the first ten; else the whole query."""
    words = F.filter(F.split(collapsed(F.lower(c)), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.when(F.size(words) > 0, F.slice(words, 1, MAX_TERMS)).otherwise(F.array(normal_query(c)))


def page_text(c: Column) -> Column:
    """White space collapsed; null where nothing is left."""
    return F.nullif(collapsed(c), F.lit(""))


def excerpt(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def location(page: Column, sheet: Column, row_start: Column, row_end: Column) -> Column:
    """Page, sheet and rows, as far as they are known."""
    return F.concat_ws(
        ", ", F.when(page > 0, F.concat(F.lit("Page "), page.cast("string"))), F.when(F.length(sheet) > 0, F.concat(F.lit("Sheet: "), sheet)),
        F.when((row_start > 0) & (row_end > 0), F.concat(F.lit("Rows "), row_start.cast("string"), F.lit("-"), row_end.cast("string"))),
    )


# The format of a context.
BETWEEN_SOURCES = "\n---\n"


def source_text(url: Column, text: Column) -> Column:
    return F.concat(F.lit("SOURCE: "), url, F.lit("\nCONTENT: "), text)


def context_text(items: Column) -> Column:
    """items: array of struct(pos, url, text); sources in order of pos, or a fixed text when there are none."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(F.array_sort(items), lambda x: source_text(x["url"], x["text"])), BETWEEN_SOURCES)).otherwise(NO_SOURCES)


def retrieval_type(mode: Column, offline_mode: Column, is_document: Column) -> Column:
    semantic = offline_mode == "semantic"
    return (
        F.when(is_document, F.when(semantic, "document_semantic").otherwise("document_keyword"))
        .when(mode == "ONLINE", "online").when((mode == "OFFLINE_ARCHIVE") & semantic, "offline_semantic").otherwise("offline_keyword")
    )


def source_record(url: Column, text: Column, filename: Column, page: Column, sheet: Column, row_start: Column, row_end: Column, kind: Column | None = None, timestamp: Column | None = None) -> Column:
    """The record shown for a context: snippet, how it was retrieved (kind, see retrieval_type) and when, what it is, location, hash and names.

    Documents have a location if any of its parts is known, web pages a hash; file and sheet names belong to documents.
    """
    is_doc = url.startswith(DOC_PREFIX)
    doc_id = F.when(is_doc, F.substring(url, F.lit(len(DOC_PREFIX) + 1), F.length(url)))
    none = F.lit(None).cast("string")
    place = F.when(is_doc & F.coalesce(page, row_start, row_end, F.when(sheet.isNotNull(), 0)).isNotNull(), F.struct(page.alias("page"), sheet.alias("sheet"), row_start.alias("row_start"), row_end.alias("row_end")))
    return F.struct(
        url.alias("url"), F.substring(F.coalesce(text, F.lit("")), 1, 500).alias("snippet"), F.when(is_doc, "document").otherwise("web").alias("source_type"),
        (none if kind is None else kind).alias("retrieval_type"), (none if timestamp is None else timestamp).alias("timestamp"), F.when(is_doc, "document").otherwise("web").alias("source_kind"),
        F.when(is_doc, filename).alias("filename"), F.when(is_doc, sheet).alias("sheet_name"),
        F.when(~is_doc & (url != FALLBACK_URL), F.md5(url)).alias("url_hash"), place.alias("location"), doc_id.alias("document_id"),
        F.when(is_doc, F.coalesce(F.nullif(filename, F.lit("")), F.nullif(doc_id, F.lit("")), F.lit("Document"))).alias("display_name"),
    )


def holding_lines(content: Column, marker: Column) -> Column:
    """Lines that hold the marker, whatever its case; the whole content when none does."""
    kept = F.filter(F.split(content, "\n"), lambda x: F.contains(F.lower(x), F.lower(marker)))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(content)


def row_lines(content: Column, number: Column) -> Column:
    """Lines of that row; the whole content when there is none."""
    kept = F.filter(F.split(content, "\n"), lambda x: F.startswith(x, F.concat(F.lit("Row "), number.cast("string"), F.lit(":"))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(content)


def last_row_line(content: Column) -> Column:
    kept = F.filter(F.split(content, "\n"), lambda x: F.startswith(x, F.lit("Row ")))
    return F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise(content)
