"""Chat formatting: a hidden Markov model recovers who speaks in a transcript, turns are rendered alike.

A transcript is a text of lines. A state is a role together with whether the line opens a turn or goes
on with one. What is seen of a line is its speaker marker (``Human:``, ``**Bot:**``, ``[Q]:``,
``<|user|>``, ``### Instruction:``, or none), whether a blank line precedes it, its length, whether it
asks, and whether it looks like an item of a list. Viterbi gives the most likely states; a turn begins
where a state opens one.

The tables are fitted by expectation-maximisation over the lines of all transcripts, from start values
that are stated below. No role is ever given to the model: markers are the only hint, and only how
often they are right (``TRUST``) is fixed.

A row is a transcript, read and decoded where it lies. A transcript that is too long for a row comes as
numbered parts. Decoding is exact all the same: a part is a matrix of best scores from the state before
it to its last one; matrices are multiplied in the max-plus sense, ``FAN`` at a time, up to one for a
transcript, and on the way back each part learns the states at its borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared, arrow_batches, look_up

ROLES = ("user", "assistant", "system")
#: Speaker markers by role, lower case (fixed values).
MARKERS = {
    "user": ("user", "human", "customer", "client", "prompter", "question", "q", "me", "usr"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "chatbot", "answer", "a", "support"),
    "system": ("system", "instruction", "instructions", "context", "developer", "sys"),
}
TRUST = 0.97
ROUNDS = 6
FAN_BITS = 9
FAN = 1 << FAN_BITS
#: Values of what is seen of a line: marker (none, one of each role, another word), after a blank
#: line, length, asks, list item.
SHAPE = (5, 2, 8, 2, 2)
CODES = int(np.prod(SHAPE))
_VALUES = np.stack(np.unravel_index(np.arange(CODES), SHAPE))
_S = 2 * len(ROLES)  # states: roles that open a turn, then roles that go on with one
_ROLE_OF = {w: i for i, r in enumerate(ROLES, 1) for w in MARKERS[r]}
_MARK = re.compile(r"\s*(?:<\|\s*([A-Za-z]+)\s*\|>|\[\s*([A-Za-z]+)\s*\]\s*:?|\*\*\s*([A-Za-z]+)\s*(?::\s*\*\*|\*\*\s*:)|#{1,4}\s*([A-Za-z]+)\s*:|([A-Za-z]+)\s*:)\s*")
_ITEM = re.compile(r"\s*(?:[-*+•]\s|\d{1,3}[.)]\s|```)")


def seen(line: str, after_blank: bool) -> tuple[int, str]:
    """The code of a line that is not blank, and the line without a marker of a role."""
    m, mark, body = _MARK.match(line), 0, line
    if m:
        mark = _ROLE_OF.get(m.group(m.lastindex).lower(), 4)
        if mark < 4:
            body = line[m.end() :]
    n = min(SHAPE[2] - 1, len(body.split()).bit_length())
    return (((mark * 2 + after_blank) * SHAPE[2] + n) * 2 + body.rstrip().endswith("?")) * 2 + bool(_ITEM.match(body)), body


def read(text: str) -> tuple[list[int], list[tuple[int, str]]]:
    """Codes of the lines of a transcript, blank ones left out; of each its number and its body."""
    codes, lines, blank = [], [], True
    for no, line in enumerate(text.split("\n")):
        if not line.strip():
            blank = True
            continue
        code, body = seen(line, blank)
        codes.append(code)
        lines.append((no, body))
        blank = False
    return codes, lines


class Model:
    """Log tables: start (6), step (6, 6) and emission (320, 6)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, tables: list[np.ndarray]):
        with np.errstate(divide="ignore"):
            self.start, self.step = np.log(start), np.log(step)
            self.emission = sum(np.log(t[:, v]) for t, v in zip(tables, _VALUES, strict=True)).T

    @staticmethod
    def prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Start values: they are also what a state without any lines keeps."""
        r = len(ROLES)
        start = np.array([0.6, 0.05, 0.3, 0.02, 0.02, 0.01])
        open_, on = np.full((r, r), 0.1), np.eye(r)
        open_[:, :] = [[0.05, 0.4, 0.02], [0.4, 0.05, 0.02], [0.45, 0.05, 0.02]]
        step = np.concatenate((np.concatenate((open_, open_)), np.concatenate((on, on)) * 0.5), axis=1)
        mark = np.array([Model.marks(0.35, 0.6, 0.05, i) for i in range(r)] + [[0.96, 0.004, 0.004, 0.004, 0.028]] * r)
        gap = np.array([[0.3, 0.7]] * r + [[0.85, 0.15]] * r)
        length = np.full((_S, SHAPE[2]), 1 / SHAPE[2])
        ask = np.array([[0.75, 0.25], [0.9, 0.1], [0.95, 0.05]] * 2)
        item = np.array([[0.97, 0.03], [0.9, 0.1], [0.95, 0.05]] * 2)
        return start / start.sum(), step / step.sum(axis=1, keepdims=True), [mark, gap, length, ask, item]

    @staticmethod
    def marks(none: float, known: float, other: float, role: int) -> list[float]:
        """Marker probabilities of a line that opens a turn of role."""
        total = none + known + other
        return [none / total, *[known / total * (TRUST if i == role else (1 - TRUST) / 2) for i in range(len(ROLES))], other / total]

    @staticmethod
    def of(start: np.ndarray, step: np.ndarray, codes: np.ndarray, weight: float = 20.0) -> Model:
        """From expected counts; the start values count like ``weight`` lines."""
        s0, t0, tables = Model.prior()
        unit = lambda x: x / x.sum(axis=-1, keepdims=True)
        out = []
        for f, t in enumerate(tables):
            c = np.stack([np.bincount(_VALUES[f], codes[:, k], minlength=SHAPE[f]) for k in range(_S)])
            out.append(unit(c + weight * t))
        for i in range(len(ROLES)):
            none, known, other = out[0][i, 0], out[0][i, 1:4].sum(), out[0][i, 4]
            out[0][i] = Model.marks(none, known, other, i)
        return Model(unit(start + weight * s0), unit(step + weight * t0), out)


def _groups(seqs: list[np.ndarray], most: int = 1 << 17) -> Iterator[np.ndarray]:
    """Indexes of the sequences in groups of alike lengths, longest first; empty ones are left out."""
    lens = np.array([len(s) for s in seqs])
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, most // int(lens[order[at]]))
        yield order[at : at + n]
        at += n


def _grid(seqs: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (T, B), and how many sequences reach each place."""
    lens = np.array([len(seqs[i]) for i in group])
    grid = np.zeros((lens[0], len(group)), np.int64)
    for b, i in enumerate(group):
        grid[: lens[b], b] = seqs[i]
    return grid, np.searchsorted(-lens, -np.arange(lens[0]), side="left")


def expected(model: Model, seqs: list[np.ndarray], later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, steps and (code, state). later: sequences that go on with a transcript."""
    a, e, begin = np.exp(model.step), np.exp(model.emission), np.exp(model.start)
    start, x, codes = np.zeros(_S), np.zeros((_S, _S)), np.zeros((CODES, _S))
    for group in _groups(seqs):
        grid, reach = _grid(seqs, group)
        alpha, scale = np.zeros((*grid.shape, _S)), np.ones(grid.shape)
        v = np.where(later[group, None], 1 / _S, begin) * e[grid[0]]
        for t in range(len(grid)):
            n = reach[t]
            if t:
                v = (alpha[t - 1, :n] @ a) * e[grid[t, :n]]
            scale[t, :n] = v.sum(axis=1)
            alpha[t, :n] = v / scale[t, :n, None]
        beta = np.ones((grid.shape[1], _S))
        for t in range(len(grid) - 1, -1, -1):
            n = reach[t]
            gamma = alpha[t, :n] * beta[:n]
            for k in range(_S):
                codes[:, k] += np.bincount(grid[t, :n], gamma[:, k], minlength=CODES)
            if t:
                back = e[grid[t, :n]] * beta[:n] / scale[t, :n, None]
                x += alpha[t - 1, :n].T @ back
                beta[:n] = back @ a.T
            else:
                start += gamma[~later[group]].sum(axis=0)
    return start, x * a, codes


def decode(model: Model, seqs: list[np.ndarray], before: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Viterbi states of each sequence. before: the state ahead of it (-1: it opens the transcript);
    last: the state that it must end with (-1: any). Ties go to the first state."""
    out = [np.zeros(0, np.int8) for _ in seqs]
    for group in _groups(seqs):
        grid, reach = _grid(seqs, group)
        back = np.zeros((*grid.shape, _S), np.int8)
        first = np.concatenate((model.step, model.start[None]))[before[group]]  # -1 is the last row
        v = first + model.emission[grid[0]]
        for t in range(1, len(grid)):
            n = reach[t]
            by = v[:n, :, None] + model.step
            back[t, :n] = by.argmax(axis=1)
            v[:n] = by.max(axis=1) + model.emission[grid[t, :n]]
        end = np.where(last[group] < 0, v.argmax(axis=1), last[group])
        states = np.zeros(grid.shape, np.int8)
        for t in range(len(grid) - 1, -1, -1):
            n, m = reach[t], reach[t + 1] if t + 1 < len(grid) else 0
            states[t, m:n] = end[m:n]
            if m:
                states[t, :m] = back[t + 1, np.arange(m), states[t + 1, :m]]
        for b, i in enumerate(group):
            out[i] = states[: len(seqs[i]), b]
    return out


def matrix(model: Model, seq: np.ndarray, opens: bool) -> np.ndarray:
    """Best score from each state before seq to each state of its last line; of a part that opens the
    transcript all rows are its best scores from the start. Without lines: nothing changes."""
    if not len(seq):
        return np.tile(model.start, (_S, 1)) if opens else np.where(np.eye(_S) > 0, 0.0, -np.inf)
    m = (np.tile(model.start, (_S, 1)) if opens else model.step) + model.emission[seq[0]]
    for c in seq[1:]:
        m = (m[:, :, None] + model.step).max(axis=1) + model.emission[c]
    return m


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = [np.array(read(t or "")[0], np.uint16).tobytes() for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary())], names=["conv_id", "part", "codes"])


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint16) for c in column.to_pylist()]


def learn(codes: DataFrame) -> Model:
    """ROUNDS of expectation-maximisation over codes (later, codes). What a round brings together is
    one number for each entry of the tables, summed in the tasks and once more over them."""
    model = Model(*Model.prior())
    sizes = (_S, _S * _S, CODES * _S)
    for _ in range(ROUNDS):
        shared = codes.sparkSession.sparkContext.broadcast(model)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(sizes))
            for b in batches:
                found = expected(shared.value, _arrays(b.column(1)), b.column(0).to_numpy(zero_copy_only=False).astype(bool))
                total += np.concatenate([x.ravel() for x in found])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["i", "x"])

        total = np.zeros(sum(sizes))
        for r in codes.select("later", "codes").mapInArrow(task, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            total[r.i] = r.x
        start, step, seen_ = np.split(np.round(total, 6), np.cumsum(sizes)[:-1])
        model = Model.of(start, step.reshape(_S, _S), seen_.reshape(CODES, _S))
    return model


def _borders(parts: DataFrame, model: Model, shared: Shared) -> DataFrame:
    """(conv_id, part, before, last) of parts (conv_id, part, lo, codes), part lo being the first."""
    cast = lambda m: pa.array(m, pa.list_(pa.float64()))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, lo = b.column(1).to_numpy(), b.column(2).to_numpy()
            found = [matrix(model, s, p == q).ravel().tolist() for s, p, q in zip(_arrays(b.column(3)), part, lo, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part - lo, pa.int64()), cast(found)], names=["conv_id", "node", "m"])

    def product(t: pa.Table) -> pa.Table:
        t, out = t.sort_by("node"), None
        for m in t.column("m").to_pylist():
            m = np.array(m).reshape(_S, _S)
            out = m if out is None else (out[:, :, None] + m).max(axis=1)
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "node": t.column("up").slice(0, 1), "m": cast([out.ravel().tolist()])})

    def split(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        ms = [np.array(m).reshape(_S, _S) for m in t.column("m").to_pylist()]
        before, scores = t.column("before")[0].as_py(), []
        for m in ms:
            scores.append(m[before] if not scores else (scores[-1][:, None] + m).max(axis=0))
        last = [t.column("last")[0].as_py()]
        for k in range(len(ms) - 1, 0, -1):
            last.append(int((scores[k - 1] + ms[k][:, last[-1]]).argmax()))
        last = last[::-1]
        return pa.table({"conv_id": t.column("conv_id"), "node": t.column("node"), "before": pa.array([before, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})

    levels = [shared.save(parts.select("conv_id", "part", "lo", "codes").mapInArrow(matrices, "conv_id bigint, node bigint, m array<double>"), "level0")]
    while levels[-1].groupBy("conv_id").count().filter("count > 1").limit(1).count():
        up = levels[-1].withColumn("up", F.shiftright("node", FAN_BITS)).groupBy("conv_id", "up").applyInArrow(product, "conv_id bigint, node bigint, m array<double>")
        levels.append(shared.save(up, f"level{len(levels)}"))
    best = F.array_position(F.slice("m", 1, _S), F.array_max(F.slice("m", 1, _S))) - 1
    found = levels[-1].select("conv_id", "node", F.lit(-1).alias("before"), best.cast("int").alias("last"))
    for k in range(len(levels) - 2, -1, -1):
        below = levels[k].withColumn("up", F.shiftright("node", FAN_BITS)).join(found.withColumnRenamed("node", "up"), ["conv_id", "up"])
        found = shared.save(below.groupBy("conv_id", "up").applyInArrow(split, "conv_id bigint, node bigint, before int, last int"), f"borders{k}")
    los = parts.groupBy("conv_id").agg(F.first("lo").alias("lo"))
    return shared.save(found.join(los, "conv_id").select("conv_id", (F.col("node") + F.col("lo")).alias("part"), "before", "last"), "borders")


def turns_of(lines: list[tuple[int, str]], states: np.ndarray) -> Iterator[tuple[int, bool, str]]:
    """(role, whether a turn of the part before goes on, body) of each turn; blank lines inside stay."""
    role, on, body, at = -1, False, [], 0
    for (no, line), s in zip(lines, states.tolist(), strict=True):
        if s < len(ROLES) or role < 0:
            if role >= 0:
                yield role, on, "\n".join(body).strip("\n")
            role, on, body = s % len(ROLES), s >= len(ROLES), []
        else:
            body += [""] * (no - at - 1)
        body.append(line)
        at = no
    if role >= 0:
        yield role, on, "\n".join(body).strip("\n")


def parse_transcripts(docs: DataFrame) -> DataFrame:
    """conv_id, part, turn, role, goes_on, rendered: the turns of docs (conv_id, text[, part]).

    Each row is a transcript; with a column ``part``, rows of one conv_id are its parts in that order,
    cut between lines. Rows without conv_id or part, and rows that repeat both, are transcripts of
    their own. turn numbers the turns of a row from 0; goes_on: the turn goes on with the last one of
    the part before. rendered: the turn under its role without its marker, ``<|`` in its text written
    as ``< |``. A null or blank text has no turns. Rows that repeat are each returned.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = Shared(spark, "chat")
    part = F.col("part").cast("bigint") if "part" in [c.lower() for c in docs.columns] else F.lit(None).cast("bigint")
    rows = docs.select(F.col("conv_id").cast("bigint").alias("conv_id"), part.alias("part"), F.col("text").cast("string").alias("text"))
    codes = shared.save(rows.mapInArrow(_codes, "conv_id bigint, part bigint, codes binary"), "codes")
    once = codes.filter("conv_id is not null and part is not null").groupBy("conv_id", "part").count().filter("count = 1")
    several = shared.save(once.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("conv_id", "lo"), "several")
    if several.limit(1).count():
        chain = shared.save(once.join(several, "conv_id").select("conv_id", "part", "lo"), "chain")
        marked = look_up(codes, chain, ["conv_id", "part"])
        model = learn(marked.withColumn("later", F.coalesce(F.col("part") > F.col("lo"), F.lit(False))))
        rows = look_up(rows, _borders(marked.filter("lo is not null"), model, shared), ["conv_id", "part"])
    else:
        model = learn(codes.withColumn("later", F.lit(False)))
        rows = rows.withColumns({"before": F.lit(None).cast("int"), "last": F.lit(None).cast("int")})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read(t or "") for t in b.column(2).to_pylist()]
            before, last = (np.array([-1 if x is None else x for x in b.column(k).to_pylist()], np.int64) for k in (3, 4))
            states = decode(model, [np.array(c, np.int64) for c, _ in found], before, last)
            row, no, role, on, text = [], [], [], [], []
            for i, ((_, lines), s) in enumerate(zip(found, states, strict=True)):
                for k, (r, goes_on, body) in enumerate(turns_of(lines, s)):
                    row.append(i)
                    no.append(k)
                    role.append(ROLES[r])
                    on.append(goes_on)
                    text.append(f"<|{ROLES[r]}|>\n{body.replace('<|', '< |')}\n<|end|>")
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(no, pa.int64()), pa.array(role, pa.string()), pa.array(on, pa.bool_()), pa.array(text, pa.string())], names=["conv_id", "part", "turn", "role", "goes_on", "rendered"])

    return rows.select("conv_id", "part", "text", "before", "last").mapInArrow(task, "conv_id bigint, part bigint, turn bigint, role string, goes_on boolean, rendered string")


#: How exported transcripts write a speaker: before the word, the word for each role, after it.
STYLES = (
    ("", ("User", "Assistant", "System"), ": "),
    ("**", ("Human", "Bot", "Context"), ":** "),
    ("<|", ("user", "assistant", "system"), "|>\n"),
    ("### ", ("Question", "Answer", "Instruction"), ":\n"),
    ("[", ("Q", "A", "SYS"), "]: "),
)
PART_TURNS = 64
HOT_TURN = 16


def transcripts(turns: DataFrame, hidden: int = 20) -> DataFrame:
    """conv_id, part, text: turns (conv_id, turn, role, text) written down as raw transcripts.

    A conversation is written in one of STYLES; of ``hidden`` turns in a hundred, by hash, the speaker
    is left out, as it is where role is none of the three. A part holds PART_TURNS turn numbers. Turn
    numbers that more than HOT_TURN rows share have parts of their own, of about a thousand rows each,
    so one conversation with very many rows is spread. Rows of one turn number follow each other by
    role and text. A row without conversation or turn number is a transcript of its own.
    """
    shared = Shared(turns.sparkSession, "transcripts")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    style, shown = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100)) >= hidden
    speaker: Column = F.lit(None).cast("string")
    for k, (left, words, right) in enumerate(STYLES):
        for role, word in zip(ROLES, words, strict=True):
            speaker = F.when((style == k) & (F.col("role") == role), F.lit(left + word + right)).otherwise(speaker)
    rows = rows.withColumn("line", F.concat(F.coalesce(F.when(shown, speaker), F.lit("")), F.col("text")))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    single = rows.filter(alone).select("conv_id", F.lit(None).cast("bigint").alias("part"), F.col("line").alias("text"))
    rows = rows.filter(~alone).withColumn("block", F.floor(F.col("turn") / PART_TURNS))
    hot = rows.groupBy("conv_id", "block", "turn").count().filter(F.col("count") > HOT_TURN)
    hot = shared.save(hot.groupBy("conv_id", "block").agg(F.max("count").alias("most")), "hot")
    if hot.limit(1).count():
        rows = look_up(rows, hot, ["conv_id", "block"])
        # a share of a hot turn number: rows with equal texts may be cut, so their place decides
        of = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.greatest(F.lit(1), F.ceil(F.col("most") / 1000)))
        rows = rows.withColumn("part", F.when(F.col("most").isNull(), F.shiftleft(F.col("block") * PART_TURNS, 24)).otherwise(F.shiftleft("turn", 24) + of))
    else:
        rows = rows.withColumn("part", F.shiftleft(F.col("block") * PART_TURNS, 24))
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "line")))
    whole = rows.groupBy("conv_id", "part").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))
    return whole.unionByName(single)


def format_chats(turns: DataFrame) -> DataFrame:
    """The turns that parse_transcripts finds in the transcripts of turns (conv_id, turn, role, text).
    What a row's role says reaches the model only as the speaker that the transcript names, if any."""
    files = Shared(turns.sparkSession, "transcripts").save(transcripts(turns), "files")
    return parse_transcripts(files)
