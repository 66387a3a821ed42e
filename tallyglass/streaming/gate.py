"""Release of streamed answers: sentences from arbitrary chunks, and a gate with one sentence in flight."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import udfs

#: Elements whose text is no answer, and the length at which a run without an end is cut.
REASONING = ("think", "thinking", "reasoning")
FLUSH_AT = 240
_OPEN, _CLOSE = (re.compile(f"<{slash}({'|'.join(REASONING)})\\s*>", re.I) for slash in ("", "/"))
_HELD = max(len(t) for t in REASONING) + 4


class Segmenter:
    """Sentences of a text that comes in chunks; state is plain, so it can be kept between batches.

    What is in reasoning elements is left out, also where a tag is split over chunks.
    """

    def __init__(self, buffer: str = "", carry: str = "", reasoning: bool = False):
        self.buffer, self.carry, self.reasoning = buffer, carry, reasoning

    def push(self, chunk: str) -> list[str]:
        self.buffer += self._answer(chunk)
        done, self.buffer = udfs.split_sentences(self.buffer)
        while len(self.buffer) >= FLUSH_AT:
            space = self.buffer.rfind(" ", 0, FLUSH_AT)
            cut = space if space > FLUSH_AT // 2 else FLUSH_AT
            done.append(self.buffer[:cut].strip())
            self.buffer = self.buffer[cut:].lstrip()
        return [s for s in done if s]

    def finish(self) -> list[str]:
        rest = self.buffer + ("" if self.reasoning else self.carry)
        self.buffer = self.carry = ""
        return [rest.strip()] if rest.strip() else []

    def _answer(self, chunk: str) -> str:
        text, self.carry, out = self.carry + chunk, "", []
        while text:
            tag = (_CLOSE if self.reasoning else _OPEN).search(text)
            if tag is None:
                at = text.rfind("<")
                if at >= 0 and len(text) - at <= _HELD and ">" not in text[at:]:
                    text, self.carry = text[:at], text[at:]
                if not self.reasoning:
                    out.append(text)
                break
            if not self.reasoning:
                out.append(text[: tag.start()])
            self.reasoning, text = not self.reasoning, text[tag.end() :]
        return "".join(out)


def released(sentences: Iterable[str], decide: Callable[[str], str], repair: Callable[[str], str | None] | None = None) -> list[tuple[int, str, str]]:
    """(index, kind, text) in order: one sentence is held while it is judged; a block ends the answer.

    kind is passed, annotated, repaired, withheld or terminated; a withheld sentence shows no text.
    """
    out = []
    for i, sentence in enumerate(sentences):
        action = decide(sentence)
        if action in ("L0_pass", "L1_annotate"):
            out.append((i, "passed" if action == "L0_pass" else "annotated", sentence))
        elif action in ("L2_repair", "L3_reroute"):
            fixed = next((x for _ in range(2) if repair and (x := repair(sentence)) and decide(x) in ("L0_pass", "L1_annotate")), None)
            out.append((i, "repaired", fixed) if fixed else (i, "withheld", ""))
        elif action == "L4_hold":
            out.append((i, "withheld", ""))
        else:
            out.append((i, "terminated", ""))
            break
    return out


def segmented(chunks: DataFrame) -> DataFrame:
    """(request_id, idx, sentence) of chunks (request_id, seq, delta); each request is folded in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = Segmenter(), []
        for delta in pdf.sort_values("seq").delta:
            out += s.push(delta or "")
        out += s.finish()
        return pd.DataFrame({"request_id": pdf.request_id.iloc[0], "idx": range(len(out)), "sentence": out}).astype({"idx": "int32"})

    return chunks.groupBy("request_id").applyInPandas(run, "request_id long, idx int, sentence string")


def by_patterns(block: str = r"(?i)ignore (?:all )?previous", hold: str = r"\b[0-9]{12}\b") -> Callable[[str], str]:
    """An action for a sentence by two patterns."""
    blocks, holds = re.compile(block), re.compile(hold)
    return lambda s: "L5_block" if blocks.search(s) else "L4_hold" if holds.search(s) else "L0_pass"


def gated(chunks: DataFrame, decide: Callable[[str], str] | None = None) -> DataFrame:
    """(request_id, idx, kind, text): sentences released, withheld or ended by a function, or by the two patterns."""
    decide = decide or by_patterns()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, sentences = Segmenter(), []
        for delta in pdf.sort_values("seq").delta:
            sentences += s.push(delta or "")
        rows = released(sentences + s.finish(), decide)
        return pd.DataFrame({"request_id": pdf.request_id.iloc[0], "idx": [r[0] for r in rows], "kind": [r[1] for r in rows], "text": [r[2] for r in rows]}).astype({"idx": "int32"})

    return chunks.groupBy("request_id").applyInPandas(run, "request_id long, idx int, kind string, text string")


def chunked(texts: DataFrame, size: int = 17) -> DataFrame:
    """(request_id, seq, delta): texts cut as a stream might bring them."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(size))
    return texts.select("request_id", "text", F.posexplode(starts).alias("seq", "at")).select("request_id", "seq", F.substring("text", F.col("at") + 1, F.lit(size)).alias("delta"))
