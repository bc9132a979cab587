"""Content onto result rows, formats and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..schema import CONTENT

FORMATS = ["markdown", "html", "json"]
PROMPT_BYTES = 60_000


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def apply_content(results: DataFrame, content: str = "content") -> DataFrame:
    """Title and unsupported are only filled in; published_at is overwritten where known; author, markdown and html
    always. Rows without content stay."""
    c = F.col(content)
    fill = lambda own, new: F.when(or_empty(F.col(own)) == "", or_empty(new)).otherwise(F.col(own))
    put = {
        "title": fill("title", c["title"]), "unsupported": fill("unsupported", c["unsupported_reason"]), "published_at": F.coalesce(c["published_at"], F.col("published_at")),
        "author": or_empty(c["author"]), "markdown": or_empty(c["markdown"]), "html": or_empty(c["cleaned_html"]),
    }
    return results.withColumns({k: F.when(c.isNull(), F.col(k)).otherwise(v) for k, v in put.items()})


def apply_rendered_content(results: DataFrame, content: str = "content") -> DataFrame:
    """Clears title and unsupported, then P2."""
    has = F.col(content).isNotNull()
    return apply_content(results.withColumns({k: F.when(has, F.lit("")).otherwise(F.col(k)) for k in ("title", "unsupported")}), content)


def project_formats(results: DataFrame, formats: Column) -> DataFrame:
    """Without a known format all stays. Else markdown and html stay if asked for, the content's markdown and HTML go, and its main
    text stays for json only."""
    asked = F.filter(F.transform(formats, lambda f: F.lower(trim_space(f))), lambda f: f.isin(FORMATS))
    none, has = F.size(asked) == 0, lambda f: F.array_contains(asked, f)
    keep = lambda name, fmt: F.when(none | has(fmt), F.col(name)).otherwise("")
    c = F.col("content")
    inner = c.withField("markdown", F.lit("")).withField("cleaned_html", F.lit("")).withField("main_text", F.when(has("json"), c["main_text"]).otherwise(""))
    return results.withColumns({"markdown": keep("markdown", "markdown"), "html": keep("html", "html"), "content": F.when(none | c.isNull(), c).otherwise(inner)})


def summarizable_body(content: Column, markdown: Column) -> Column:
    """P25: the first of content.markdown, content.main_text and the row's markdown that is not blank."""
    filled = lambda c: F.when(trim_space(or_empty(c)) != "", c)
    return F.coalesce(filled(content["markdown"]), filled(content["main_text"]), filled(markdown))


def sanitize_page(text: Column) -> Column:
    """a zero-width space breaks closing page tags."""
    return F.regexp_replace(text, "(?i)</page", "<​page")


def cut_bytes(text: Column, most: int) -> Column:
    """The first ``most`` bytes, whole characters only."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.try_to_utf8(raw) if hasattr(F, "try_to_utf8") else F.make_valid_utf8(raw.cast("string")), "�+$", ""))


def summarize_prompt(body: Column, fmt: Column, instructions: Column) -> Column:
    """F29."""
    style = F.when(trim_space(or_empty(fmt)) == "", "markdown").otherwise(trim_space(fmt))
    extra = F.when(trim_space(or_empty(instructions)) != "", F.concat(F.lit(" Extra instructions: "), trim_space(instructions))).otherwise("")
    return F.concat(F.lit("Summarize the page below as "), style, F.lit("."), extra, F.lit("\n\n<page>\n"), sanitize_page(cut_bytes(body, PROMPT_BYTES)), F.lit("\n</page>\n"))


def apply_artifact(results: DataFrame, blob: str) -> DataFrame:
    """A cached JSON artifact as content, applied by P2."""
    return apply_content(results.withColumn("content", F.from_json(blob, CONTENT)))


def merge_auto_render(results: DataFrame, rendered: DataFrame, key: str = "canonical", order: str = "pos") -> DataFrame:
    """Rows that need scripts take the rendered page's content where there is one, unless that needs scripts too. Of several
    renders of a key the first in the order counts, so a result stays one row; results without a key take none."""
    fresh = rendered.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("content", order).alias("_rendered"))
    fresh = fresh.filter("_rendered.unsupported_reason is null or _rendered.unsupported_reason <> 'js_required'")
    both = results.join(fresh, key, "left")
    use = (F.col("unsupported") == "js_required") & F.col("_rendered").isNotNull()
    return apply_rendered_content(both.withColumn("_use", F.when(use, F.col("_rendered"))), "_use").withColumn("content", F.coalesce("_use", "content")).drop("_use", "_rendered")
