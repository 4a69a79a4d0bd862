"""Secret scans: probabilistic automata inferred from labelled credentials score candidate strings.

For each format, labelled credentials make a prefix tree. Layer by layer, states whose next symbols are distributed compatibly (Hoeffding's
bound on each symbol's frequency and on the frequency of ending) are merged, and with them their subtrees. States of
one depth only are merged where a format has fixed lengths, so that its automaton keeps them and its fixed parts, and joins its random
parts. Formats of any length (LOOPS) merge across depths between two dots, so that their random parts become loops with no longest length.
A candidate scores the log-likelihood of the likeliest format less that of plain text of its kind; candidates are the runs of
token characters and their parts between separators, from the length of the shortest labelled credential on (shortest()). A password that reads like
a word or name isn't told from one by its format, and isn't found; neither is one with characters that tokens don't have.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hecespark.llm.arrow import steps
from hecespark.runtime import bind

THRESHOLD = 8.0  # of the score, in nats
#: Formats that are held against text made of words and numbers, which says more than plain text does: so much will do.
NAMED, NAMED_THRESHOLD = ("assigned_mixed", "assigned_base64"), 4.0
ALPHA, SMOOTH, SAMPLES, SEED = 0.01, 0.01, 1200, 7
#: What comes first in a labelled string: whether it is assigned to a name such as password or api_key.
ASSIGNED, BARE = "=", " "
CONTEXT = re.compile(rb"""(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|bearer|key)["']?\s{0,3}(?:[:=]|=>|:=)?\s{0,3}["']?""")
MASK = "[SECRET]"
#: Formats whose parts have no fixed length, and those that are known by their name and their look alone.
LOOPS = ("jwt", "assigned_hex", "assigned_hex_upper", "assigned_mixed", "assigned_base64")
ASSIGNED_ONLY = LOOPS[1:]
#: Nats by which a score may fall where a longer part of a run is taken for the credential; less than a wrong symbol costs.
LONGER = 5.0

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT


def labelled(samples: int = SAMPLES, seed: int = SEED) -> dict[str, list[str]]:
    """Credentials by their published formats, each with its context symbol. Drawn here, as no table has such labels."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    url64 = _ALNUM + "-_"
    either = lambda: rng.choice((ASSIGNED, BARE))
    length = lambda: int(8 * 16 ** rng.random())  # noqa: E731  (8 to 127, as many of 8 to 15 as of 64 to 127)
    make = {
        "aws_access_key": lambda: either() + rng.choice(("AKIA", "AKIA", "AKIA", "ASIA")) + some(_UPPER + _DIGIT, 16),
        "github_token": lambda: either() + rng.choice(("ghp_", "gho_", "ghu_", "ghs_", "ghr_")) + some(_ALNUM, 36),
        "github_fine_token": lambda: either() + "github_pat_" + some(_ALNUM, 22) + "_" + some(_ALNUM, 59),
        "slack_token": lambda: either() + rng.choice(("xoxb-", "xoxp-", "xoxa-")) + some(_DIGIT, 12) + "-" + some(_DIGIT, 12) + "-" + some(_ALNUM, 24),
        "payment_key": lambda: either() + rng.choice(("sk_live_", "rk_live_", "sk_test_")) + some(_ALNUM, 24),
        "google_key": lambda: either() + "AIza" + some(url64, 35),
        "jwt": lambda: either() + "eyJ" + some(url64, rng.randint(12, 90)) + ".eyJ" + some(url64, int(20 * 30 ** rng.random())) + "." + some(url64, rng.choice((43, 43, 64, 86, 171, 342, 512, 683))),
        "assigned_hex": lambda: ASSIGNED + some(_DIGIT + "abcdef", length()),
        "assigned_hex_upper": lambda: ASSIGNED + some(_DIGIT + "ABCDEF", length()),
        "assigned_mixed": lambda: ASSIGNED + some(_ALNUM, length()),
        "assigned_base64": lambda: ASSIGNED + some(_ALNUM + "+/", rng.choice((24, 32, 40, 40, 43, 64, 86))),
    }
    return {kind: [f() for _ in range(samples)] for kind, f in make.items()}


def compatible(a: dict[str, int], b: dict[str, int], alpha: float = ALPHA) -> bool:
    """Hoeffding's test on the frequency of each symbol; '' counts the strings that end."""
    n, m = sum(a.values()), sum(b.values())
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return all(abs(a.get(s, 0) / n - b.get(s, 0) / m) <= bound for s in a.keys() | b.keys())


class Automaton:
    """moves[state][symbol] = (next state, log-probability); ends[state] = log-probability of ending; other symbols cost ``unseen``."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.moves: list[dict[str, tuple[int, float]]] = []
        self.ends: list[float] = []
        layer, depth, base = [list(range(len(samples)))], 0, 0
        self.unseen = math.log(SMOOTH / (len(samples) + 1))
        while layer:
            merged: list[tuple[list[int], dict[str, int]]] = []
            place = {}
            for k in sorted(range(len(layer)), key=lambda k: -len(layer[k])):
                counts: dict[str, int] = {}
                for i in layer[k]:
                    s = samples[i][depth : depth + 1]
                    counts[s] = counts.get(s, 0) + 1
                for at, (members, known) in enumerate(merged):
                    if compatible(known, counts, alpha):
                        members.extend(layer[k])
                        for s, c in counts.items():
                            known[s] = known.get(s, 0) + c
                        break
                else:
                    at = len(merged)
                    merged.append((list(layer[k]), counts))
                place[k] = base + at
            if depth:
                for state, symbol, k, logp in pending:
                    self.moves[state][symbol] = (place[k], logp)
            following, pending = [], []
            for members, counts in merged:
                n, state = sum(counts.values()), len(self.moves)
                self.moves.append({})
                self.ends.append(math.log(counts[""] / n) if "" in counts else self.unseen)
                parts: dict[str, list[int]] = {}
                for i in members:
                    if s := samples[i][depth : depth + 1]:
                        parts.setdefault(s, []).append(i)
                for s, part in parts.items():
                    pending.append((state, s, len(following), math.log(len(part) / n)))
                    following.append(part)
            base, layer, depth = len(self.moves), following, depth + 1

    @classmethod
    def looped(cls, samples: list[str], alpha: float = ALPHA) -> Automaton:
        """States of any depth are merged that have as many dots before them; strings that follow a merged move stay in its loop."""
        a = cls([])
        a.unseen = math.log(SMOOTH / (len(samples) + 1))
        counts: list[dict[str, int]] = [{}]
        dots, moves = [0], [{}]
        arrived: dict[int, list[tuple[str, int]]] = {0: [(s, 0) for s in samples]}
        while arrived:
            following: dict[int, list[tuple[str, int]]] = {}
            for state in sorted(arrived, key=lambda k: -len(arrived[k])):
                parts: dict[str, list[tuple[str, int]]] = {}
                for s, at in arrived[state]:
                    parts.setdefault(s[at : at + 1], []).append((s, at + 1))
                for c, part in parts.items():
                    counts[state][c] = counts[state].get(c, 0) + len(part)
                for c, part in sorted(parts.items(), key=lambda x: -len(x[1])):
                    if not c:
                        continue
                    to = moves[state].get(c)
                    if to is None:
                        ahead: dict[str, int] = {}
                        for s, at in part:
                            ahead[s[at : at + 1]] = ahead.get(s[at : at + 1], 0) + 1
                        before = dots[state] + (c == ".")
                        to = next((k for k in range(len(counts)) if dots[k] == before and counts[k] and compatible(counts[k], ahead, alpha)), len(counts))
                        if to == len(counts):
                            counts.append({})
                            dots.append(before)
                            moves.append({})
                        moves[state][c] = to
                    following.setdefault(to, []).extend(part)
            arrived = following
        total = [sum(c.values()) for c in counts]
        a.moves = [{c: (to, math.log(counts[k][c] / total[k])) for c, to in m.items()} for k, m in enumerate(moves)]
        a.ends = [math.log(c[""] / n) if "" in c else a.unseen for c, n in zip(counts, total)]
        return a

    def parts(self, text: str, stops: list[int], mark: str, slack: float = 25.0) -> list[tuple[int, float]]:
        """(stop, log-likelihood) of the starts of text up to each of ``stops``, until they are hopelessly unlikely."""
        step = self.moves[0].get(mark)
        total, state = (self.unseen, 0) if step is None else (step[1], step[0])
        out, moves, unseen, begin = [], self.moves, self.unseen, 0
        for stop in stops:
            for c in text[begin:stop]:
                step = moves[state].get(c)
                if step is None:
                    total += unseen
                else:
                    state, p = step
                    total += p
                begin += 1
                if total < begin * _UNIFORM - slack:
                    return out
            out.append((stop, total + self.ends[state]))
        return out

    def log_likelihood(self, text: str, floor: float = -math.inf) -> float:
        """Of the whole text, or -inf as soon as it is under floor. An unseen symbol is passed over, at its cost."""
        total, state, moves, unseen = 0.0, 0, self.moves, self.unseen
        for c in text:
            step = moves[state].get(c)
            if step is None:
                total += unseen
            else:
                state, p = step
                total += p
            if total < floor:
                return -math.inf
        return total + self.ends[state]


@cache
def automata() -> dict[str, Automaton]:
    return {kind: (Automaton.looped if kind in LOOPS else Automaton)(samples) for kind, samples in labelled().items()}


@cache
def shortest(assigned: bool) -> int:
    """The length of the shortest credential that is labelled with the context or without it: what is shorter is no candidate."""
    mark = ASSIGNED if assigned else BARE
    return min(len(s) - 1 for samples in labelled().values() for s in samples if s[0] == mark)


_UNIFORM, _LETTER, _FIGURE = math.log(1 / 66), math.log(1 / 18), math.log(1 / 10)
#: A word in capitals, of this length, is so much rarer (in nats) than one in small letters.
_CAPITALS = 10.0


def plain(text: str) -> float:
    """Log-likelihood of text that is no credential: of any characters, or of a word or number where it is one."""
    n = len(text)
    if text.isalpha() and (text[1:].islower() or text.isupper()):
        return n * _LETTER - _CAPITALS * text.isupper()
    return n * (_FIGURE if text.isdigit() else _UNIFORM)


#: Of letters in European text, a to z.
_LETTERS = dict(zip(_LOWER, (math.log(f / 100) for f in (8.2, 1.5, 3.2, 4.2, 14.0, 1.6, 1.9, 3.5, 7.2, 0.3, 0.8, 4.4, 2.6, 7.8, 6.4, 2.2, 0.3, 6.6, 6.6, 7.4, 3.6, 1.1, 1.3, 0.2, 1.2, 0.6))))
#: Names and paths go on with characters of the same class, or change it.
_STAY, _CHANGE = math.log(0.85), math.log(0.15 / 3)


def named(text: str) -> float:
    """Log-likelihood of text that is made of words, numbers and separators, as names and paths are."""
    total, last = 0.0, ""
    for k, c in enumerate(text):
        now = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "."
        following = now == last or (now == "a" and last == "A" and (k < 2 or not text[k - 2].isupper()))  # a capital begins a word
        total += (_STAY if following else _CHANGE if last else 0.0) + (_LETTERS.get(c.lower(), _UNIFORM) if now in "aA" else _FIGURE if now == "0" else math.log(1 / 5))
        last = now
    return total


def best(text: str, stops: list[int], mark: str, kinds: tuple[str, ...]) -> tuple[float, int, str]:
    """The score, stop and format of the likeliest credential that text begins with; of nearly the same likelihood, the longest. ('' under the threshold.)"""
    found: list[tuple[float, int, str]] = []
    for kind in kinds:
        for stop, p in automata()[kind].parts(text, stops, mark):
            value = text[:stop]
            base, least = (named(value), NAMED_THRESHOLD) if kind in NAMED else (plain(value), THRESHOLD)
            if p - base >= least:
                found.append((p - base, stop, kind))
    if not found:
        return 0.0, 0, ""
    top = max(found)
    return max((x for x in found if x[2] == top[2] and x[0] >= top[0] - LONGER), key=lambda x: x[1])


_SEPARATOR = re.compile(r"[_+/.-]")


def secrets_of(value: str, assigned: bool) -> list[tuple[int, int, str, float]]:
    """(start, stop, kind, score) of the credentials in a run: parts of it that begin and end at separators; else, where it is assigned, the whole."""
    cuts = [m.start() for m in _SEPARATOR.finditer(value)]
    known = tuple(k for k in automata() if k not in ASSIGNED_ONLY)
    out, done, least = [], 0, shortest(False)
    for start in [0, *(c + 1 for c in cuts)]:
        if start < done or len(value) - start < least:
            continue
        # the formats' own beginnings decide after a few characters: only where one fits are the stops looked at
        head = value[start : start + 3]
        if not any(_begins(k, head) for k in known):
            continue
        stops = [c - start for c in cuts if c >= start + least] + [len(value) - start]
        found, stop, kind = best(value[start:], stops, ASSIGNED if assigned and not start else BARE, known)
        if kind:
            out.append((start, start + stop, kind, found))
            done = start + stop
    if not out and assigned:
        found, stop, kind = best(value, [len(value)], ASSIGNED, ASSIGNED_ONLY)
        if kind:
            out.append((0, stop, kind, found))
    return out


@cache
def _begins(kind: str, head: str) -> bool:
    """Whether the format's automaton has moves for the characters."""
    a = automata()[kind]
    state = a.moves[0][BARE][0]
    for c in head:
        if c not in a.moves[state]:
            return False
        state = a.moves[state][c][0]
    return True


_table = np.zeros(256, bool)
_table[np.frombuffer((_ALNUM + "_-+/.").encode(), np.uint8)] = True


def find(texts: list[str | None]) -> Iterator[tuple[int, int, int, str, float]]:
    """(text number, start, stop, kind, score) of the secrets, in characters. Runs of token characters are candidates, and so are their parts."""
    data = [(t or "").encode() for t in texts]
    whole = b"\n".join([*data, b""])
    ends = np.cumsum([len(d) + 1 for d in data])
    inside = np.r_[False, _table[np.frombuffer(whole, np.uint8)], False]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = turns[::2], turns[1::2]
    after = np.array([m.end() for m in CONTEXT.finditer(whole)], np.int64)  # where what is assigned to a name begins
    # separators around a run aren't part of it: what is assigned may begin after some of them, and the run is looked at whole
    near = np.searchsorted(starts, after, side="right") - 1
    given = np.zeros(len(starts), bool)
    given[near[(near >= 0) & (stops[near] > after)] if len(starts) else near[:0]] = True
    long = stops - starts >= np.where(given, shortest(True), shortest(False))
    starts, stops, given = starts[long], stops[long], given[long]
    owner = np.searchsorted(ends, starts, side="right")
    contexts = set(after.tolist())
    for i, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist()):
        raw = whole[a:b]
        value = raw.strip(b".-+/")
        a += len(raw) - len(raw.lstrip(b".-+/"))
        begin = int(ends[i]) - len(data[i]) - 1
        assigned = a in contexts and a > begin
        if len(value) < shortest(assigned):
            continue
        for x, y, kind, found in secrets_of(value.decode(), assigned):
            start = len(whole[begin : a + x].decode())
            yield i, start, start + y - x, kind, found


def scan_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        rows = list(find(batch.column("text").to_pylist()))
        ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
        columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.float64()))]
        yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "start", "stop", "kind", "score"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, kind, score): a row for each secret, with its place in characters. Null and empty texts have none; repeated rows repeat theirs."""
    return docs.select("doc_id", "text").mapInArrow(bind(__name__, "scan_kernel"), "doc_id bigint, start bigint, stop bigint, kind string, score double")


def mask_kernel(batches: Iterator[pa.RecordBatch], text: str, size: str | None) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, text):
        texts = batch.column(text).to_pylist()
        by: dict[int, list[tuple[int, int]]] = {}
        for i, a, b, _, _ in find(texts):
            by.setdefault(i, []).append((a, b))
        if by:
            for i, spans in by.items():
                for a, b in reversed(spans):
                    texts[i] = texts[i][:a] + MASK + texts[i][b:]
            columns = list(batch.columns)
            columns[batch.schema.get_field_index(text)] = pa.array(texts, batch.schema.field(text).type)
            if size is not None:
                at = batch.schema.get_field_index(size)
                lengths = columns[at].to_pylist()
                for i in by:
                    lengths[i] = len(texts[i])
                columns[at] = pa.array(lengths, batch.schema.field(size).type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        yield batch


def mask(docs: DataFrame) -> DataFrame:
    """All documents, each secret replaced by MASK and n_chars (if there is one) put right where a text changed. Null and empty texts stay
    as they are, repeated rows are masked alike, and other columns, whatever their names, aren't touched."""
    return docs.mapInArrow(bind(__name__, "mask_kernel", "text", "n_chars" if "n_chars" in docs.columns else None), docs.schema)
