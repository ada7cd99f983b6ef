"""Secret scans: fixed patterns, and formats inferred as grammars from labelled credentials.

The fixed patterns (assign, access, hex) give the base spans. The method adds spans of kind ``format``: every run of
credential characters outside them, or what they leave of one, is a candidate if it is as long as the shortest labelled
credential, scored by the best automaton's log-likelihood over that of a background of ordinary words, a character. Automata are inferred for each kind of labelled credential: those that the
caller gives, those drawn from public formats (``public_formats``), and the base matches in all texts. The threshold lies
halfway between most candidates that no base pattern covers and nearly all labelled credentials, at 1 or more, but never
so high that it loses more than a twentieth of the latter.

All documents teach, with every distinct match and candidate: tasks count what follows each prefix of a credential, the
driver merges the tree of the prefixes that enough strings begin with (``least_of``; its size does not grow with the
corpus), tasks run all strings through the automata and count their steps, and then score all strings for the two
quantiles, which are read from counts of scores to 1/1024. The kinds of labelled credentials weigh alike in theirs.

Edge cases: null texts are empty and have no spans; offsets are code points; null ids and repeated rows stay; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, pick
from .grammar import Automaton, prefixes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: No labelled credential is shorter.
LEAST = 6
KEYWORDS = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "format")

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(raw: bytes, text: str) -> list[Span]:
    """The fixed patterns' spans, by start and kind. raw: the text in UTF-8."""
    low = raw.lower()
    out: list[Span] = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[Span], least: int) -> Iterator[tuple[int, int, str]]:
    """Runs that could be credentials, of ``least`` characters or more; of runs that base spans cut, the pieces."""
    for m in re.finditer(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{least},}}", text):
        a, end = m.span()
        for x, _, y in [*(s for s in base if s[0] < end and a < s[2]), (end, 0, end)]:  # by start
            word = text[a:x].rstrip(".=-")
            if len(word) >= least:
                yield a, a + len(word), word
            a = max(a, y)


def public_formats(each: int = 200) -> list[tuple[str, str]]:
    """Labelled examples (kind, value) of published credential formats, drawn from their descriptions."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = upper + lower + digits
    # fixed values: prefix, characters, length of what follows
    formats = {
        "access": ("AKIA", upper + "234567", 16),
        "hex40": ("", digits + "abcdef", 40),
        "hex32": ("", digits + "abcdef", 32),
        "git": ("ghp_", word, 36),
        "chat": ("xoxb-", digits, 24),
        "maps": ("AIza", word + "-_", 35),
        "pay": ("sk_live_", word, 24),
        "web": ("eyJ", word + "-_", 60),
        "store": ("", word + "+/", 40),
    }
    out = []
    for kind, (prefix, chars, n) in formats.items():
        for k in range(each):
            stream = b"".join(hashlib.sha256(f"{kind}|{k}|{j}".encode()).digest() for j in range(-(-n // 32)))
            out.append((kind, prefix + "".join(chars[x * len(chars) >> 8] for x in stream[:n])))
    return out


@dataclass
class Scorer:
    """Automata by kind, the background's character pairs, the threshold, and the least length of a candidate."""

    automata: dict[str, Automaton]
    pairs: dict[str, int]
    firsts: dict[str, int]
    threshold: float = 0.0
    least: int = LEAST
    known: dict[str, bool] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        whole = {a: log(n + 0.5 * 70) for a, n in self.firsts.items()}
        self.after = {p: log(n + 0.5) - whole[p[0]] for p, n in self.pairs.items()}
        self.never = {a: log(0.5) - w for a, w in whole.items()}

    def background(self, s: str) -> float:
        out = 0.0
        for a, b in zip("\n" + s, s + "\n", strict=True):
            x = self.after.get(a + b)
            out += self.never.get(a, -log(70)) if x is None else x
        return out

    def score(self, s: str) -> float:
        """The best format's log-likelihood over the background's, a character."""
        best = max((a.log_likelihood(s) for a in self.automata.values()), default=float("-inf"))
        return (best - self.background(s)) / (len(s) + 1)

    def accepts(self, s: str) -> bool:
        """Whether the score reaches the threshold; remembers the words met last."""
        out = self.known.get(s)
        if out is None:
            if len(self.known) >= 100_000:
                self.known.clear()
            out = self.known[s] = self.score(s) >= self.threshold
        return out


#: Distinct strings that a task holds before it passes them on.
HELD = 200_000
#: Scores are told apart to one in so many.
FINE = 1024


def _rows(kinds: list[str], values: list[str], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], names=["kind", "value", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, value, n: base matches and loose candidates, each once a while, and the background's character pairs."""
    pairs: Counter = Counter()
    seen: set[tuple[str, str]] = set()
    loose: set[str] = set()
    whole: Counter = Counter()  # runs of texts without base spans: candidates as they are
    other: Counter = Counter()

    def out() -> pa.RecordBatch:
        for words in (whole, other):
            for word, n in words.items():
                if not re.search(r"[0-9]{3}", word):
                    for a, b in zip("\n" + word, word + "\n", strict=True):
                        pairs[a + b] += n
        loose.update(x for x in (word.rstrip(".=-") for word in whole) if len(x) >= LEAST)
        rows = [*seen, *(("loose", x) for x in loose)]
        for held in (seen, loose, whole, other):
            held.clear()
        return _rows([k for k, _ in rows], [v for _, v in rows], [1] * len(rows))

    for batch in batches:
        for x in batch.column("text"):
            text = x.as_py() or ""
            base = base_spans(text.encode(), text)
            for a, k, b in base:
                seen.add((f"seen {KINDS[k]}", ASSIGN.match(text, a)[2] if k == 0 else text[a:b]))
            if base:
                loose.update(word for _, _, word in candidates(text, base, LEAST))
            (other if base else whole).update(re.findall(r"[A-Za-z0-9+/_.=-]{4,}", text))
            if len(seen) + len(loose) + len(whole) + len(other) > HELD:
                yield out()
    yield out()
    yield _rows(["pair"] * len(pairs), list(pairs), list(pairs.values()))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings to (kind, h, c, n): how often a symbol follows a prefix."""

    def out() -> pa.RecordBatch:
        keys = list(counts)
        columns = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["kind", "h", "c", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True):
            counts.update((kind, h, c) for h, c in prefixes(value))
            if len(counts) > HELD:
                yield out()
                counts.clear()
    yield out()


def _steps(automata: object):
    """Strings to (kind, h, c, n): how often a state, h, of their kind's automaton took a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True):
                counts.update((kind, k, c) for k, c in automata.value[kind].steps(value))
        keys = list(counts)
        columns = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["kind", "h", "c", "n"])

    return run


def _scores(scorer: object):
    """Strings to (kind, score, n): how many have a score, as a whole number of ``FINE`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True):
                counts[kind, int(scorer.value.score(value) * FINE // 1)] += 1
        keys = list(counts)
        columns = [pa.array([k for k, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["kind", "score", "n"])

    return run


def at(weights: dict[int, float], place: float) -> float:
    """The least score up to which there is more weight than ``place``, or the last; scores in parts of ``FINE``."""
    for x in sorted(weights):
        place -= weights[x]
        if place < 0:
            break
    return x / FINE


def quantile(counts: dict[int, int], q: float) -> float:
    """Between the two scores that stand nearest to the share ``q``."""
    place = q * (sum(counts.values()) - 1)
    low = at(counts, int(place))
    return low + (place - int(place)) * (at(counts, int(place) + 1) - low)


#: Values of a kind from which its prefix tree is counted by the tasks.
WHOLE = 20


def least_of(n: int) -> int:
    """Of n strings, how many have to begin with a prefix to make it a state: so at most 1,024 prefixes of a length do."""
    return max(8, ceil(n / 1024))


def learn(documents: DataFrame, credentials: DataFrame | None = None) -> Scorer:
    """A scorer from all documents (doc_id, text) and labelled credentials (kind, value)."""
    spark = documents.sparkSession
    found = documents.select("text").mapInArrow(_examples, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    if credentials is not None:
        own = pick(credentials, kind="string", value="string").where(f"kind is not null and length(value) >= {LEAST}").select(F.concat(F.lit("own "), "kind").alias("kind"), "value", F.lit(1).cast("bigint").alias("n"))
        found = found.union(own.distinct())
    found = durable(found)
    pairs = {r.value: r.n for r in found.where("kind = 'pair'").collect()}  # at most 71 * 71 rows
    firsts: Counter = Counter()
    for k, n in pairs.items():
        firsts[k[0]] += n
    # a row for each kind
    kinds = found.where("kind not in ('pair', 'loose')").groupBy("kind").agg(F.count("*").alias("n"), F.min(F.length("value")).alias("least"))
    known = kinds.orderBy("kind").collect()
    sizes = {r.kind: r for r in known if r.n >= WHOLE}
    public: dict[str, list[str]] = {}
    for kind, value in public_formats():
        public.setdefault(f"public {kind}", []).append(value)
    # kinds of a few values are learned from the values as they stand, fewer than WHOLE of a kind
    few = [r.kind for r in known if r.n < WHOLE]
    for r in found.where(F.col("kind").isin(few)).orderBy("kind", "value").collect() if few else ():
        public.setdefault(r.kind, []).append(r.value)
    automata: dict[str, Automaton] = {}
    if sizes:
        taught = found.where(F.col("kind").isin(list(sizes))).select("kind", "value")
        follow = taught.mapInArrow(_follow, "kind string, h long, c string, n long").groupBy("kind", "h", "c").agg(F.sum("n").alias("n"))
        follow = follow.groupBy("kind", "h").agg(F.sum("n").alias("n"), F.collect_list(F.struct("c", "n")).alias("to"))
        enough = spark.createDataFrame([(k, least_of(r.n)) for k, r in sizes.items()], "kind string, enough long")
        trees: dict[str, dict[int, dict[str, int]]] = {k: {} for k in sizes}
        for r in follow.join(F.broadcast(enough), "kind").where("n >= enough or h = 0").select("kind", "h", "to").collect():  # bounded by least_of
            trees[r.kind][r.h] = {x.c: x.n for x in r.to}
        automata = {k: Automaton.from_prefixes(tree, least=least_of(sizes[k].n)) for k, tree in trees.items()}
        taken: dict[str, dict[tuple[int, str], int]] = {k: {} for k in sizes}
        for r in taught.mapInArrow(_steps(spark.sparkContext.broadcast(automata)), "kind string, h long, c string, n long").groupBy("kind", "h", "c").agg(F.sum("n").alias("n")).orderBy("kind", "h", "c").collect():
            taken[r.kind][r.h, r.c] = r.n  # states by symbols
        for k, automaton in automata.items():
            automaton.counted(taken[k])
    automata |= {k: Automaton(v) for k, v in public.items()}
    least = min([*(len(v) for values in public.values() for v in values), *(r.least for r in sizes.values())])
    out = Scorer(automata, pairs, dict(firsts), least=max(LEAST, least))
    some = found.where(F.col("kind").isin(list(sizes)) | ((F.col("kind") == "loose") & (F.length("value") >= out.least))).select("kind", "value")
    good: Counter = Counter()
    bad: dict[int, int] = {}
    for kind, values in public.items():
        for v in values:
            good[int(out.score(v) * FINE // 1)] += 1 / len(values)
    for r in some.mapInArrow(_scores(spark.sparkContext.broadcast(out)), "kind string, score long, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).orderBy("kind", "score").collect():
        if r.kind == "loose":
            bad[r.score] = r.n
        else:
            good[r.score] += r.n / sizes[r.kind].n
    # loose candidates may hold real credentials, so that the few highest must not set the threshold
    low, high = quantile(bad or {0: 1}, 0.75), at(good, 0.05 * sum(good.values()))
    out.threshold = min(high, max(1.0, (low + high) / 2))
    return out


def find(raw: bytes | None, scorer: Scorer | None) -> tuple[str, list[Span]]:
    """A text and all its spans, by start and kind."""
    text = (raw or b"").decode()
    base = base_spans(raw or b"", text)
    if scorer is None:
        return text, base
    return text, sorted([*base, *((a, 3, b) for a, b, word in candidates(text, base, scorer.least) if scorer.accepts(word))])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPANS_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(shared: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for x in batch.column("text").cast(pa.binary()):
                _, spans = find(x.as_py(), scorer)
                kinds = [k for _, k, _ in spans]
                base = joined([s for s in spans if s[1] < 3])
                values = (*(kinds.count(k) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), joined(spans))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds_ = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds_, strict=True))], names=SPANS_DDL.replace(",", "").split()[::2])

    return run


def scan(documents: DataFrame, credentials: DataFrame | None = None) -> DataFrame:
    """The spans of every whole text, a row for each document."""
    bounded_batches(documents.sparkSession)
    rows = pick(documents, doc_id="bigint", text="string")
    shared = documents.sparkSession.sparkContext.broadcast(learn(rows, credentials))
    return rows.mapInArrow(_scan(shared), SPANS_DDL)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each maximal run of spans replaced by ``[secret]``."""
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], "[secret]"]
        elif b > done and not out:
            out.append("[secret]")
        done = max(done, b)
    return "".join([*out, text[done:]])


def _redacted(shared: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            texts, sizes = [], []
            for x in batch.column("text").cast(pa.binary()):
                raw = x.as_py()
                text, spans = find(raw, scorer)
                texts.append(None if raw is None else redact(text, spans) if spans else text)
                sizes.append(len(texts[-1] or ""))
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def redacted_documents(documents: DataFrame, credentials: DataFrame | None = None) -> DataFrame:
    """The documents with their secrets replaced; whole rows, all kept."""
    bounded_batches(documents.sparkSession)
    rows = pick(documents, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    shared = documents.sparkSession.sparkContext.broadcast(learn(rows, credentials))
    return rows.mapInArrow(_redacted(shared), rows.schema)
