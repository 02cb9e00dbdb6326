"""Passes over texts in an order that is checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import markup as M
from quirework.functions import rules as R
from quirework.operators import repair, structure


@dataclass(frozen=True)
class Pass:
    """A step from (key, text) to (key, text).

    needs: what must have been given before; gives: what it gives; breaks: what no longer holds after it, so that a pass that needs
    it can't follow unless it is given again. rereads: it looks at its texts more than once.
    """

    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: frozenset[str] = field(default_factory=frozenset)
    gives: frozenset[str] = field(default_factory=frozenset)
    breaks: frozenset[str] = field(default_factory=frozenset)
    rereads: bool = True


def checked(passes: Sequence[Pass], given: frozenset[str] = frozenset()) -> list[Pass]:
    """The passes, if each finds what it needs; else a ValueError that names the pass and what it lacks."""
    holds = set(given)
    for step in passes:
        if missing := step.needs - holds:
            raise ValueError(f"{step.name} needs {', '.join(sorted(missing))} before it")
        holds = holds - step.breaks | step.gives
    return list(passes)


def applied(documents: DataFrame, passes: Sequence[Pass], given: frozenset[str] = frozenset(), kept: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Documents after all passes, in order; nothing is planned if the order is wrong.

    kept writes texts and reads them again, before each pass that looks at them more than once; without it such a pass works out
    all passes before it anew each time.
    """
    for n, step in enumerate(checked(passes, given)):
        if kept and n and step.rereads:
            documents = kept(documents, f"{n:02d}-{step.name}")
        documents = documents.transform(step.run)
    return documents


def _on_text(change: Callable) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("text", change(F.col("text")))


def course_passes(key: str = "doc_id", tails: DataFrame | None = None, suffixes: DataFrame | None = None) -> list[Pass]:
    """The passes that prepare course texts, in their order; those by evidence only where it is given.

    Marks stand at their words before anything is cut at visible places; spacing is settled before titles are compared with the
    source's; headings are whole before levels are given; and exams are bounded last, since they need the levels. Joining
    tails moves marks, so emphasis is put right again after it.
    """
    emphasis = Pass("emphasis", _on_text(M.repaired_emphasis), gives=frozenset({"emphasis"}), rereads=False)
    passes = [emphasis]
    if tails is not None:
        passes += [Pass("tails", lambda df: repair.joined_tails(df, tails, key).select(key, "text"), needs=frozenset({"emphasis"}), breaks=frozenset({"emphasis"})), emphasis]
    passes.append(Pass("spacing", _on_text(R.legal_spacing), needs=frozenset({"emphasis"}), gives=frozenset({"spacing"}), rereads=False))
    if suffixes is not None:
        passes.append(Pass("headings", lambda df: structure.split_headings(df, suffixes, key), needs=frozenset({"emphasis", "spacing"})))
    passes.append(Pass("structure", lambda df: structure.structured(df, key), needs=frozenset({"emphasis", "spacing"}), gives=frozenset({"levels"})))
    passes.append(Pass("exams", lambda df: structure.exam_boundaries(df, key), needs=frozenset({"levels"}), gives=frozenset({"boundaries"})))
    return passes
