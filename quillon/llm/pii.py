"""Personal data: patterns of seed entities, learned by bootstrapping, find further ones."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, written

KINDS = ("email", "ip", "card", "phone")
#: Rounds of pattern and instance scores.
ROUNDS = 3
#: A pattern needs so many distinct instances of its kind and this score; an instance of no base kind needs the second.
SEEDS, PATTERN_SCORE, INSTANCE_SCORE = 8, 0.8, 0.8
#: Weight of an instance of unknown kind against a pattern, and pseudo-instances against every pattern.
UNKNOWN, AGAINST = 0.2, 1.0
#: Digits that a number without a pattern of its own needs, and groups of digits that one may have.
LEAST_DIGITS, MOST_GROUPS = 7, 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[0-9().\x20-]*[0-9])?(?![A-Za-z0-9])")
_AT = re.compile(r"(?:@|\(at\)|\[at\]| at )", re.I)
_SIGNS = ("@", "(at)", "[at]", " at ", "(AT)", "[AT]", " AT ")
_DIGIT = re.compile("[0-9]")
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\x20?\Z")
_AFTER = re.compile(r"\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]+)*", re.I)
_GROUP = re.compile(r"[^\x20]+")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_matches(text: str) -> list[list[tuple[int, int, bool]]]:
    """(start, end, passes) of the leftmost non-overlapping matches of each kind, in time linear in the text."""
    emails, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            emails.append((start, m.end(), True))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    ips = []
    for m in _DOTTED.finditer(text):
        # a chain of numbers gives one match for each four of them
        places = [(x.start(), x.end()) for x in re.finditer(r"[0-9]+", m[0])]
        for i in range(0, len(places) - 3, 4):
            four = places[i : i + 4]
            parts = [m[0][a:b].lstrip("0") or "0" for a, b in four]
            ok = all(len(x) <= 3 and int(x) <= 255 for x in parts)
            ips.append((m.start() + four[0][0], m.start() + four[3][1], ok))
    cards = []
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        cards.append((m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)))
    phones = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum("0" <= c <= "9" for c in m[0])
            phones.append((m.start(), m.end(), 9 <= n <= 15))
    return [emails, ips, cards, phones]


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", s))


def _near(text: str, at: int, step: int) -> list[str]:
    """The two words before (step -1) or after a place, in lower case without outer signs, the nearest first."""
    piece = text[max(0, at - 80) : at] if step < 0 else text[at : at + 80]
    words = [w.strip(".,:;=#!?\"'()[]{}<>*|").lower() for w in _WORD.findall(piece)[:: step][:4]]
    return [w for w in words if w][:2]


def candidates(text: str, base: list) -> list[tuple]:
    """(start, end, kind or -1, kinds it failed as bits, class) of all that may be personal data.

    Base matches, numbers of up to ``MOST_GROUPS`` groups and what is written like
    an address; parts of matches that failed their check are candidates, too."""
    out = [(a, b, k, 0, ("at", "dotted", "number", "number")[k]) for k, found in enumerate(base) for a, b, ok in found if ok]
    known = {(a, b) for a, b, *_ in out}
    failed: dict[tuple, int] = {}
    for k, found in enumerate(base):
        for a, b, ok in found:
            if not ok:
                failed[a, b] = failed.get((a, b), 0) | 1 << k
    taken = sorted(known)
    furthest = list(itertools.accumulate((y for _, y in taken), max))

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (b,))  # base entities that begin before the end
        return not i or furthest[i - 1] <= a

    for m in _NUMBERS.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for i in range(len(groups)):
            for j in range(i, min(len(groups), i + MOST_GROUPS)):
                a, b = groups[i][0], groups[j][1]
                if (a, b) not in known and len(_digits(text[a:b])) >= LEAST_DIGITS and b - a <= 40 and free(a, b):
                    value = text[a:b]
                    bad = failed.get((a, b), 0)
                    d = _digits(value)
                    if _CARD.fullmatch(value) and not (13 <= len(d) <= 19 and luhn(d)):
                        bad |= 1 << 2
                    if _PHONE.fullmatch(value) and not 9 <= len(d) <= 15:
                        bad |= 1 << 3
                    four = re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", value)
                    out.append((a, b, -1, bad | 2 if four else bad, "dotted" if four else "number"))
    if any(x in text for x in _SIGNS):
        for m in _AT.finditer(text):
            before, after = _BEFORE.search(text[max(0, m.start() - 80) : m.start()]), _AFTER.match(text[m.end() : m.end() + 160])
            plain = m[0].lower() == " at "
            if not before or not after or plain and not re.search(r"\.|dot", after[0], re.I):
                continue
            a, b = m.start() - len(before[0]), m.end() + len(after[0].rstrip(" "))
            if (a, b) not in known and free(a, b):
                out.append((a, b, -1, 0, "at"))
    return out


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - 2**63


def patterns_of(text: str, start: int, end: int, kind: str) -> list[int]:
    """Hashes of the patterns that a candidate stands in: its shape, its neighbours with its class, and both."""
    left, right, shape = _near(text, start, -1), _near(text, end, 1), _shape(text[start:end])
    digits = _digits(text[start:end]) if kind == "number" else ""
    if 13 <= len(digits) <= 19 and "." not in shape:
        shape += "|sum" if luhn(digits) else "|no sum"
    out = [f"s|{shape}"]
    if left:
        out += [f"l|{left[0]}|{kind}", f"ls|{left[0]}|{shape}"]
        if len(left) > 1:
            out.append(f"ll|{left[1]}|{left[0]}|{kind}")
        if right:
            out.append(f"lr|{left[0]}|{right[0]}|{kind}")
    if right:
        out.append(f"r|{right[0]}|{kind}")
    return [_hash(p) for p in out]


def _instance(value: str, kind: str) -> int:
    """Numbers are the same whatever their signs; addresses whatever their case."""
    return _hash(f"{kind}|" + (_digits(value) if kind == "number" else value.lower()))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_MENTION = "array<struct<start: int, end: int, kind: int, failed: int, instance: bigint, patterns: array<bigint>>>"


def _scan(batch: pa.RecordBatch):
    counts, digests, spans, found = [[] for _ in KINDS], [], [], []
    for text in batch.column("text").to_pylist():
        text = text or ""
        some = _DIGIT.search(text) or any(x in text for x in _SIGNS)
        base = base_matches(text) if some else [[]] * 4
        good = [(k, a, b) for k, m in enumerate(base) for a, b, ok in m if ok]
        for k in range(4):
            counts[k].append(sum(g[0] == k for g in good))
        line = _joined(good)
        digests.append(hashlib.sha256(line.encode()).hexdigest())
        spans.append(line)
        mentions = candidates(text, base) if some else []
        found.append(
            [{"start": a, "end": b, "kind": k, "failed": bad, "instance": _instance(text[a:b], c), "patterns": patterns_of(text, a, b, c)} for a, b, k, bad, c in mentions] or None
        )
    yield batch.column("row"), batch.column("doc_id"), *counts, digests, spans, found


def _known(edges: DataFrame) -> DataFrame:
    """``instance, kind, failed, score``: a base kind (the first of several) has score 1, others none yet."""
    kind = F.min(F.when(F.col("kind") >= 0, F.col("kind")))
    return edges.groupBy("instance").agg(kind.alias("kind"), F.bit_or("failed").alias("failed")).withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))


def score_patterns(edges: DataFrame, instances: DataFrame, seeds: int = SEEDS, least: float = PATTERN_SCORE) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns that can be trusted.

    The confidence of a pattern for a kind is the score of its instances of that
    kind against those of other kinds, those that failed the kind's check, and,
    with the weight ``UNKNOWN``, those of no kind."""
    e = edges.join(instances, "instance")
    total = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"p{k}") for k in range(len(KINDS))]
    failed = [F.count_if(F.col("kind").isNull() & (F.col("failed").bitwiseAND(1 << k) != 0)).alias(f"f{k}") for k in range(len(KINDS))]
    g = e.groupBy("pattern").agg(*total, *failed, F.count_if(F.col("kind").isNull()).alias("unknown"))
    known = sum((F.col(f"p{k}") for k in range(1, len(KINDS))), F.col("p0"))
    rows = [
        F.struct(F.lit(k).alias("kind"), F.col(f"p{k}").alias("p"), (F.col(f"p{k}") / (known + F.col(f"f{k}") + UNKNOWN * (F.col("unknown") - F.col(f"f{k}")) + AGAINST)).alias("confidence"))
        for k in range(len(KINDS))
    ]
    return g.select("pattern", F.explode(F.array(*rows)).alias("k")).select("pattern", "k.*").where((F.col("p") >= seeds) & (F.col("confidence") >= least)).drop("p")


def score_instances(edges: DataFrame, instances: DataFrame, trusted: DataFrame, least: float = INSTANCE_SCORE) -> DataFrame:
    """``instances`` with what trusted patterns say of those without a base kind.

    ``1 - prod(1 - confidence)`` over the patterns of a kind; a kind whose check
    the instance failed is left out; ties go to the first kind."""
    said = edges.join(trusted, "pattern").groupBy("instance", F.col("kind").alias("told")).agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(1 - 1e-9)))))).alias("s"))
    open_ = instances.where("score < 1").select("instance", "failed")
    best = (
        said.join(open_, "instance")
        .where(F.col("failed").bitwiseAND(F.expr("shiftleft(1, told)")) == 0)
        .groupBy("instance")
        .agg(F.min(F.struct((-F.col("s")).alias("s"), "told")).alias("best"))
        .where(-F.col("best.s") >= least)
    )
    out = instances.join(best, "instance", "left")
    return out.select(
        "instance",
        F.when(F.col("score") == 1.0, F.col("kind")).otherwise(F.col("best.told")).alias("kind"),
        "failed",
        F.when(F.col("score") == 1.0, 1.0).otherwise(F.coalesce(-F.col("best.s"), F.lit(0.0))).alias("score"),
    )


def _finish(batch: pa.RecordBatch):
    spans, added = [], []
    for base, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist(), strict=True):
        held = [(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
        n = len(held)
        for m in sorted(more or (), key=lambda m: (-m["score"], m["start"] - m["end"], m["start"])):
            if not any(m["start"] < b and a < m["end"] for _, a, b in held):
                held.append((m["kind"], m["start"], m["end"]))
        spans.append(_joined(held)), added.append(len(held) - n)
    yield *(batch.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")), spans, added


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, seeds: int = SEEDS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` per row.

    The base entities of a text (see :func:`base_matches`) are the seeds. Every
    candidate stands in patterns: its shape, the words before and after it, and
    pairs of these. Patterns and instances form a graph whose edges Spark counts
    over all documents: a pattern is trusted for a kind if enough distinct
    instances of it bear that kind and few others stand in it; an instance
    without a kind takes one that trusted patterns agree on, and counts for the
    patterns of the next round. After ``rounds`` rounds the candidates whose
    instance has a kind are added where they overlap no base entity and no better
    candidate. What failed the check of a kind never takes that kind.

    ``n_email`` and so on count the base entities, of which ``base_sha256`` is
    the digest; ``spans`` lists all, ``n_added`` counts the others.

    Texts are read once, in the tasks; candidates are few beside them. Edges are
    reduced before they are shuffled, and scores are aggregates joined by
    pattern or instance, so that a pattern of very many instances is never
    gathered.

    Edge cases: null and empty texts have no entities. Ids may be null or repeat:
    rows are told apart by a number. Very long texts are read whole. Repeated
    rows weigh once, as instances are distinct. An empty table gives no rows.
    Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    scan = written(arrow_map(source, _scan, f"row long, doc_id long, {counts}, base_sha256 string, base string, found {_MENTION}"), "scan")
    mentions = scan.where("found is not null").select("row", F.explode("found").alias("m")).select("row", "m.*")
    edges = written(mentions.select("instance", "kind", "failed", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("kind").alias("kind"), F.bit_or("failed").alias("failed")), "edges")
    instances = written(_known(edges), "instances")
    links = edges.select("instance", "pattern")
    for _ in range(rounds):
        trusted = written(score_patterns(links, instances, seeds), "patterns")
        before, instances = instances, written(score_instances(links, instances, trusted), "instances")
        discard(before, trusted)
    good = instances.where(F.col("kind").isNotNull() & (F.col("score") >= INSTANCE_SCORE)).select("instance", F.col("kind").alias("told"), "score")
    more = (
        mentions.where("kind < 0")
        .join(good, "instance")
        .where(F.col("failed").bitwiseAND(F.expr("shiftleft(1, told)")) == 0)
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "end", F.col("told").alias("kind"), "score")).alias("more"))
    )
    joined = scan.drop("found").join(more, "row", "left").drop("row")
    return arrow_map(joined, _finish, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
