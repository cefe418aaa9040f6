"""Runs in stages: pipelines that stop where a row is settled, passes over providers, calls with one retry, caches and jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.windows import in_order

Step = Callable[[DataFrame], DataFrame]

#: What an attempt leaves on a row, dropped before the next; outcomes that are asked again; a page's age in a cache.
ATTEMPT = (
    "recognized", "rawRecognized", "match", "safety", "recognitionSource", "candidates", "error", "koreanAttempted", "verifiedPDF", "patentPDF", "technicalPDF",
    "identifierPDF", "cacheState", "fieldChoice", "fieldEdit", "advice", "manualReview", "authoritative", "verification", "evidence", "restore", "restoreGate",
    "coverProposal", "completion", "fieldConflicts", "selection", "staleGeneration", "lookupUnreachable", "lookupNotes", "ocrRead", "attempts", "recognizedWith", "storedDifference",
)
RETRIED = ("rateLimited", "serverError")
PAGE_HOURS = 24


def run_stages(rows: DataFrame, steps: Sequence[tuple[str, Step]], settled: Column, stage: str = "stage") -> DataFrame:
    """``rows`` after the first of ``steps`` that settles each; rows that none settles are of stage ``none``.

    A step gets the rows that are open and returns them with the same columns,
    so later and dearer steps see few. ``settled`` is a condition on these.
    """
    open_, done = rows, []
    for name, step in steps:
        tried = step(open_).withColumn(stage, F.lit(name))
        done.append(tried.where(settled))
        open_ = tried.where(~F.coalesce(settled, F.lit(False))).drop(stage)
    out = open_.withColumn(stage, F.lit("none"))
    for part in done:
        out = out.unionByName(part)
    return out


def search_passes(documents: DataFrame, answers: DataFrame, key: str, passes: Sequence[tuple[str, Column]]) -> DataFrame:
    """The first pass over ``answers`` that gives a document one: key, pass and answer (the least of several).

    Each pass is a name and a condition on answers; documents that an earlier
    pass has answered are left out of later ones.
    """
    # One pass over the answers: the least of each pass that has any, of which the first counts. Buffers are plain numbers where answers are.
    least = [F.min(F.when(c, F.col("answer"))).alias(f"_a{i}") for i, (_, c) in enumerate(passes)]
    any_ = [F.max(F.coalesce(c, F.lit(False))).alias(f"_h{i}") for i, (_, c) in enumerate(passes)]
    by = answers.groupBy(key).agg(*least, *any_).where(F.greatest(F.lit(False), *(F.col(f"_h{i}") for i in range(len(passes)))))
    first = F.coalesce(*(F.when(F.col(f"_h{i}"), F.struct(F.col(f"_a{i}").alias("answer"), F.lit(name).alias("pass"))) for i, (name, _) in enumerate(passes)))
    return by.join(documents.select(key), key, "left_semi").select(key, first.alias("_f")).select(key, "_f.answer", "_f.pass")


def guarded_calls(attempts: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """The outcome of each call from its attempts in order: the first, or the second where the first asks for a retry."""
    first_two = F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k")))), 1, 2)["k"]
    rows = attempts.groupBy(key).agg(first_two.alias("tried"))
    again = F.get("tried", 0).isin(*RETRIED) & (F.size("tried") > 1)
    return rows.select(key, F.when(again, F.get("tried", 1)).otherwise(F.get("tried", 0)).alias("outcome"), F.when(again, 2).otherwise(1).alias("calls"))


def cached_pages(loads: DataFrame, url: str, at: str, usable: Column, hours: int = PAGE_HOURS) -> DataFrame:
    """``loads`` with whether a cache answers each: a usable page of the same address was stored at most ``hours`` before.

    A load that the cache answers stores nothing, so a page's age counts from
    the load that stored it; the fold runs over one address in order of time.
    """
    rows = loads.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000.0
    by = rows.groupBy(url).agg(F.array_sort(F.collect_list(F.struct(seconds.alias("s"), F.struct(*loads.columns).alias("row"), F.col("_ok").alias("ok")))).alias("all"))

    def step(state: Column, x: Column) -> Column:
        hit = F.coalesce(x["s"] - state["stored"] <= hours * 3600, F.lit(False))
        stored = F.when(hit, state["stored"]).when(x["ok"], x["s"])
        return F.struct(stored.alias("stored"), F.concat(state["out"], F.array(F.struct(x["row"].alias("row"), hit.alias("hit")))).alias("out"))

    row_type = T.StructType(loads.schema.fields).simpleString()
    start = F.struct(F.lit(None).cast("double").alias("stored"), F.array().cast(f"array<struct<row:{row_type},hit:boolean>>").alias("out"))
    return by.select(F.inline(F.aggregate("all", start, step, lambda s: s["out"]))).select("row.*", "hit")


def reset_attempts(rows: DataFrame) -> DataFrame:
    """``rows`` as before any attempt: what attempts leave is gone, the status pending, nothing ticked or changed."""
    kept = rows.drop(*ATTEMPT)
    for name, value in (("status", F.lit("pending")), ("checked", F.lit(False))):
        kept = kept.withColumn(name, value)
    return kept.withColumn("changes", F.array().cast("array<string>"))


def selection_trace(entries: DataFrame, key: str, candidate: str, order: str) -> DataFrame:
    """For each key its candidates' latest entries, in order: an entry takes the place of an earlier one of its candidate."""
    latest = entries.groupBy(key, candidate).agg(F.max(order).alias("_last"))
    return latest.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_last", candidate))), lambda x: x[candidate]).alias("trace"))


def latest_job(manifests: DataFrame, saved: DataFrame, job: str, key: str, status: str = "status") -> DataFrame:
    """The rows of the latest job whose manifest has any, with their saved status, or pending where none was saved."""
    newest = manifests.where(F.col(key).isNotNull()).agg(F.max(job).alias("_newest"))
    rows = manifests.join(F.broadcast(newest), F.col(job) == F.col("_newest")).select(job, key)
    return rows.join(saved.select(job, key, status), [job, key], "left").withColumn(status, F.coalesce(status, F.lit("pending")))


def write_job(rows: DataFrame, folder: str, key: str, job: int) -> None:
    """A job's manifest and row files; each appears whole, by Spark's commit, or not at all."""
    rows.select(key, "title").write.mode("errorifexists").json(f"{folder}/job={job}/manifest")
    rows.write.mode("errorifexists").json(f"{folder}/job={job}/rows")


def sources_after_link(combined: Column, linked: Column, earlier: Column) -> Column:
    """Sources (kind, label, title, abstract) after a link: the combined one, earlier links and the new one for their abstracts alone, then layers."""
    only = lambda s: F.struct(F.lit("link").alias("kind"), s["label"].alias("label"), F.lit(None).cast("string").alias("title"), s["abstract"].alias("abstract"))
    stated = lambda s: F.trim(F.coalesce(s["abstract"], F.lit(""))) != ""
    links = F.transform(F.filter(earlier, lambda s: (s["kind"] == "link") & stated(s)), only)
    blank = F.struct(F.lit("link").alias("kind"), linked["label"].alias("label"), F.lit(None).cast("string").alias("title"), F.when(stated(linked), linked["abstract"]).alias("abstract"))
    new = F.when(linked.isNotNull(), F.array(blank)).otherwise(F.slice(links, 1, 0))
    return F.concat(F.array(combined), links, new, F.filter(earlier, lambda s: s["kind"] == "layer"))


def part_of(part: Column, whole: Column) -> Column:
    """A part's record from its own title and pages and the rest of its whole; null if the whole has no title."""
    fields = F.struct(
        F.lit("bookSection").alias("type"), part["title"].alias("title"), whole["title"].alias("book_title"), part["pages"].alias("pages"),
        whole["publisher"].alias("publisher"), whole["year"].alias("year"), whole["isbn"].alias("isbn"),
    )
    return F.when(F.trim(F.coalesce(whole["title"], F.lit(""))) != "", fields)


def whole_of(part: Column) -> Column:
    """A whole's record from a part's: its container's title, without pages; null if it names none."""
    fields = F.struct(F.lit("book").alias("type"), part["book_title"].alias("title"), part["publisher"].alias("publisher"), part["year"].alias("year"), part["isbn"].alias("isbn"))
    return F.when(F.trim(F.coalesce(part["book_title"], F.lit(""))) != "", fields)


def scope_of(kind: Column, pages: Column, book_title: Column, num_pages: Column) -> Column:
    """Whether a record is of a part or a whole, by its type, else by what it states; unknown where it states neither."""
    stated = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""
    return (
        F.when(kind.isin("bookSection", "conferencePaper", "encyclopediaArticle"), "part").when(kind.isin("book", "thesis", "report"), "whole")
        .when(stated(book_title) | stated(pages) & pages.cast("string").rlike(r"^\d+\s*[-–]\s*\d+$"), "part").when(stated(num_pages), "whole").otherwise("unknown")
    )


def fetched(urls: DataFrame, key: str, fetch: Callable[[str], tuple[int, str]], retries: int = 1) -> DataFrame:
    """Each url's answer by an injected ``fetch`` (url to status and body): key, url, status, body and calls.

    It runs in the tasks, a batch at a time; an answer of 429 or 5xx is asked for
    again. Tests and offline runs pass a function that reads fixtures.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, url in zip(frame[key], frame["url"], strict=True):
                for call in range(1, retries + 2):
                    status, body = fetch(url)
                    if status != 429 and status < 500:
                        break
                out.append((k, url, status, body, call))
            yield pd.DataFrame(out, columns=[key, "url", "status", "body", "calls"])

    kind = urls.schema[key].dataType.simpleString()
    return urls.select(key, "url").mapInPandas(run, f"{key} {kind}, url string, status int, body string, calls int")


def created_parents(files: DataFrame, key: str, estimate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """New parents for ``files`` by an injected ``estimate`` of their type and title, and the files refused for want of a type."""
    guessed = estimate(files)
    return guessed.where("type IS NOT NULL").withColumn("parent", F.xxhash64(key)), guessed.where("type IS NULL").select(key)


def label_pattern(meanings: dict[str, Sequence[str]], wanted: Sequence[str] | None = None, seat: str = "start") -> str:
    """A pattern of the label words of the wanted meanings: at a line's start, its end, or the whole of it; longer words first."""
    from re import escape

    words = sorted({w for m in (wanted or meanings) for w in meanings[m]}, key=lambda w: (-len(w), w))
    body = "(?:" + "|".join(escape(w).replace(r"\ ", r"\s+") for w in words) + ")"
    return "(?i)" + {"start": rf"^\s*{body}\s*[:：]", "end": rf"{body}\s*$", "whole": rf"^\s*{body}\s*[:：]?\s*$"}[seat]


def latest_before(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Each row's predecessor in time within its keys, as ``previous``."""
    return rows.withColumn("previous", F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))


def run_rows(rows: DataFrame, done: DataFrame, key: str, work: Step) -> DataFrame:
    """``work`` on the rows that no earlier run has done: key, place in order, state (done or failed) and error.

    A row's failure is a value of the ``error`` column that ``work`` adds, so
    others go on.
    """
    open_ = work(rows.join(done.select(key).distinct(), key, "left_anti"))
    state = F.when(F.col("error").isNull(), "done").otherwise("failed")
    return in_order(open_, F.col(key), name="n").select(key, "n", state.alias("state"), "error")
