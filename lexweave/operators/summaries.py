"""Per-term summaries: prompts, routing, and a keyed artifact that a run resumes and merges into."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators import glossary as g
from lexweave.operators.documents import CORPUS_ORDER

SUMMARY_SCHEMA = "term_key string, term string, occurrence_count long, summary string, summary_source string, generated_at string"
FAILURE_SCHEMA = "term_key string, term string, error string, updated_at string"

# The notices that stand for a summary, their sources, and the head of a prompt's table.
NOT_APPLIED = "LLM is not applied to the term %s."
USED_ONCE = "The term '%s' is only used once in the provided texts."
NOT_USED = "The term '%s' is not used in the provided texts."
NOTICE_SOURCE, LOCAL_SOURCE = "LLM not applied", "local occurrence notice"
TABLE_HEAD = "| Statement | Sentence |\n| --- | --- |"


def not_applied(term: Column) -> Column:
    return F.format_string(NOT_APPLIED, term)


def local_notice(term: Column, n: Column) -> Column:
    return F.when(n == 1, F.format_string(USED_ONCE, term)).when(n == 0, F.format_string(NOT_USED, term))


def prompts(terms: DataFrame, occurrences: DataFrame, template: str, sources: dict[str, str]) -> DataFrame:
    """term_key, prompt: template with {term}, {statement_sentence_table} and, for each placeholder of sources, the definitions of
    that source filled in, one after another. terms as from glossary.grouped; occurrences with term_key and corpus order.

    A prompt is one text with all sentences of its term, as a model reads it; pass the terms that are asked for only."""
    if not template.strip():
        raise ValueError("the prompt template is empty")
    row = F.concat(F.lit("| "), t.table_cell(F.col("statement")), F.lit(" | "), t.table_cell(F.col("sentence")), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*CORPUS_ORDER, row.alias("row")))), lambda r: r["row"])
    tables = occurrences.groupBy("term_key").agg(F.count("*").alias("c"), rows.alias("rows"))
    held = terms.join(tables, "term_key", "left")
    head = F.concat(F.lit("Occurrence count: "), F.coalesce("c", F.lit(0)).cast("string"), F.lit("\n\n" + TABLE_HEAD))
    filled = F.replace(F.lit(template), F.lit("{term}"), F.col("term"))
    for name, source in sources.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), g.definition_of(F.col("definitions"), source))
    table = F.concat_ws("\n", head, F.nullif(F.array_join("rows", "\n"), F.lit("")))
    return held.select("term_key", F.replace(filled, F.lit("{statement_sentence_table}"), table).alias("prompt"))


def routes(terms: DataFrame, counts: DataFrame, existing: DataFrame, overwrite: bool = False, excluded: tuple[str, ...] = ("confidence",), strict_recheck: bool = False) -> DataFrame:
    """term_key, term, n, route (skip, notice, local, model), summary (what skip keeps or a notice says).

    A stored summary is kept for terms in repeated use even where it is an old notice; strict_recheck asks the model again
    then."""
    held = terms.select("term_key", "term").join(counts.select("term_key", F.col("n")), "term_key", "left").join(existing.select("term_key", F.col("summary").alias("old"), "summary_source"), "term_key", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    is_out = F.col("term_key").isin(*excluded)
    made = F.when(is_out, not_applied(F.col("term"))).when(n <= 1, local_notice(F.col("term"), n))
    has = F.coalesce(t.stripped(F.col("old")) != "", F.lit(False))
    keep = F.lit(not overwrite) & has & F.when(made.isNotNull(), F.col("old") == made).otherwise(~F.lit(strict_recheck) | ~F.coalesce(F.col("summary_source") == LOCAL_SOURCE, F.lit(False)))
    route = F.when(keep, "skip").when(is_out, "notice").when(n <= 1, "local").otherwise("model")
    return held.select("term_key", "term", n.alias("n"), route.alias("route"), F.when(keep, F.col("old")).otherwise(made).alias("summary"))


def unknown_terms(requested: DataFrame, terms: DataFrame) -> DataFrame:
    return requested.select(t.folded(F.col("term")).alias("term_key")).distinct().join(terms, "term_key", "left_anti")


def selected(terms: DataFrame, requested: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """The requested terms, else the first limit of them by folded display form, else all."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    if requested:
        return terms.filter(F.col("term_key").isin(*[r.lower().replace("ß", "ss") for r in requested]))
    return terms if limit is None else terms.orderBy(t.folded(F.col("term")), "term_key").limit(limit)


def current(records: DataFrame, terms: DataFrame) -> DataFrame:
    """The records of terms that the glossary still has."""
    return records.join(terms.select("term_key"), "term_key", "left_semi")


def merged(summaries: DataFrame, failures: DataFrame, done: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New summaries over old ones; a failure goes with its term's success, and a failed term keeps its old summary."""
    kept = summaries.join(done.select("term_key"), "term_key", "left_anti").unionByName(done)
    still = failures.join(done.select("term_key"), "term_key", "left_anti").join(failed.select("term_key"), "term_key", "left_anti").unionByName(failed)
    return kept, still


#: Errors of the program itself: they end the job instead of being recorded as a term's failure.
BUGS = (NameError, AttributeError, TypeError, ImportError, SyntaxError)


def run_model(prompted: DataFrame, ask: Callable[[str], str], source: str, stamp: str, answers: str | None = None, pause: float = 0.0) -> DataFrame:
    """term_key, term, n, prompt to answers: adds summary or error, row by row on the executors, with a pause behind each request.

    With a folder for answers each one is kept there as soon as it is given, under the hash of its term and prompt; what is kept
    is not asked for again, neither by a repeated task nor by a later run. Failures are not kept. An answer without text and
    whatever ask raises are failures, but for BUGS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None if answers is None else Answers(answers)
        for batch in batches:
            out = []
            for key, p in zip(batch["term_key"], batch["prompt"], strict=True):
                said = None if kept is None else kept.get(key, p)
                if said is not None:
                    out.append((said, None))
                    continue
                try:
                    said = ask(p)
                    if not isinstance(said, str) or not said.strip():
                        raise RuntimeError("no summary text")
                except BUGS:
                    raise
                except Exception as e:  # noqa: BLE001  whatever else fails is recorded with its term
                    out.append((None, f"{type(e).__name__}: {e}"))
                    continue
                out.append((said.strip(), None))
                if kept is not None:
                    kept.put(key, p, said.strip())
                time.sleep(pause)
            yield batch[["term_key", "term", "n"]].assign(summary=[x for x, _ in out], error=[x for _, x in out])

    asked = prompted.select("term_key", "term", F.col("n").cast("long").alias("n"), "prompt").mapInPandas(run, "term_key string, term string, n long, summary string, error string")
    return asked.select("term_key", "term", F.col("n").alias("occurrence_count"), "summary", "error", F.lit(source).alias("summary_source"), F.lit(stamp).alias("at"))


class Answers:
    """A folder of one file for each answer, in any store that pyarrow knows. A file is written beside and renamed."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)

    def _at(self, key: str, prompt: str) -> str:
        return f"{self.root}/{hashlib.sha256(json.dumps([key, prompt]).encode()).hexdigest()}.txt"

    def get(self, key: str, prompt: str) -> str | None:
        at = self._at(key, prompt)
        if self.store.get_file_info(at).type.name != "File":
            return None
        with self.store.open_input_stream(at) as data:
            return data.read().decode()

    def put(self, key: str, prompt: str, said: str) -> None:
        at = self._at(key, prompt)
        beside = f"{at}.{uuid.uuid4().hex}.tmp"
        with self.store.open_output_stream(beside) as out:
            out.write(said.encode())
        self.store.move(beside, at)

    def clear(self) -> None:
        self.store.delete_dir(self.root)


def outcome(routed: DataFrame, failed: DataFrame) -> DataFrame:
    """completed, skipped, failed of a run."""
    lost = routed.join(failed.select("term_key", F.lit(True).alias("f")), "term_key", "left")
    return lost.agg(F.count_if((F.col("route") != "skip") & F.col("f").isNull()).alias("completed"), F.count_if(F.col("route") == "skip").alias("skipped"), F.count_if(F.col("f")).alias("failed"))
