"""Personal data: base patterns, and terms that give a protected entity away, by corpus co-occurrence.

Every e-mail address, IP address, card and phone number is a protected entity. Terms (words of three letters or more) within
``REACH`` words of one are its context. With p over documents, a term t discloses entity e by PMI(e; t) = log p(e,t) / p(e)
p(t), against the entity's own information IC(e) = -log p(e). The share PMI / IC is 1 + log p(e|t) / IC(e); p(e|t) enters by
its lower bound of confidence ``SURE``, for as many observations as there are different windows, so copies of one text are
one observation and a pair seen once or twice counts by what it can tell. Rare entities are pooled too: by mail domain or the
first digits, and by kind.

Terms whose share reaches ``GENERALISE`` are generalised (to their word class) and from ``REMOVE`` on removed: wherever they stand in a document that names the entity
(or one of its pool), and those of ``REMOVE`` and more in all documents.

Defined results: a null text is empty; an empty table gives no rows; repeated rows are found each; a term inside a base span
is left to that; base spans always stay.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import Cover, arrow_pass, saved, table
from .secretscan import digest

KINDS = ("email", "ip", "card", "phone", "term")
#: An address is looked for at its @, an IP only where digits begin: neither tries every start within a long run.
_LOCAL, _DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Longer runs of letters are no terms.
LONGEST_TERM = 64
REACH, SUPPORT, GENERALISE, REMOVE, SURE = 10, 1, 0.9, 0.97, 2 / 3
#: Up to this many candidate terms are counted by a set in every task; more are counted by a join.
TERMS_IN_TASK = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: what may stand before an @ up to the last match, and its domain."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = []
    out += [(0, s, e) for s, e in emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def entity_of(text: str, kind: int, start: int, end: int) -> str:
    own = text[start:end]
    return f"{KINDS[kind]}:{own.lower() if kind == 0 else re.sub('[^0-9.]', '', own)}"


def pools(entity: str) -> list[str]:
    """An entity and what it is pooled with: its mail domain, network or first six digits, and its kind."""
    kind, own = entity.split(":", 1)
    part = own[own.rindex("@") :] if kind == "email" else own.rsplit(".", 1)[0] + "." if kind == "ip" else own[:6] + "-"
    return [entity, f"{kind}:{part}", f"{kind}:"]


def _terms(text: str) -> list[re.Match]:
    return [m for m in _WORD.finditer(text) if m.end() - m.start() <= LONGEST_TERM]


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Terms within reach of each span: entity, term, where, and a fingerprint of the window."""
    out, cover, terms = [], Cover((s, e) for _, s, e in spans), _terms(text)
    starts = [m.start() for m in terms]
    for kind, s, e in spans:
        entity = entity_of(text, kind, s, e)
        first, last = bisect_left(starts, s), bisect_left(starts, e)
        near = terms[max(0, first - REACH) : first] + terms[last : last + REACH]
        window = [m for m in near if not cover.touches(m.start(), m.end())]
        mark = zlib.crc32(" ".join(m.group().lower() for m in window).encode("utf-8", "replace"))
        out += [{"entity": entity, "term": m.group().lower(), "window": mark, "start": m.start(), "end": m.end()} for m in window]
        # seen without any term the entity still counts
        out += [] if window else [{"entity": entity, "term": None, "window": mark, "start": s, "end": s}]
    return out


def _document_counts(docs: DataFrame, terms: DataFrame, terms_in_task: int) -> DataFrame:
    """In how many documents each of ``terms`` stands: (term, df)."""
    few = None
    if terms.count() <= terms_in_task:
        few = frozenset(r[0] for r in terms.collect())

    def make():
        def run(cols: dict) -> dict:
            counts: dict[str, int] = {}
            for t in cols["text"]:
                words = {w for w in _WORD.findall(t.lower()) if len(w) <= LONGEST_TERM} if t else set()
                for w in words & few if few is not None else words:
                    counts[w] = counts.get(w, 0) + 1
            return {"term": list(counts), "n": list(counts.values())}

        return run

    if few is not None and not few:
        return terms.select("term", F.lit(0).cast("bigint").alias("df"))
    counted = arrow_pass(docs.select("text"), make, "term string, n bigint", rows=2048)
    return counted.groupBy("term").agg(F.sum("n").alias("df")).join(terms, "term", "left_semi")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ``_row``, which tells texts apart: rows that share it and the doc_id have the same text."""
    return docs.withColumn("_row", F.xxhash64("text", "doc_id"))


def telling_terms(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, terms_in_task: int = TERMS_IN_TASK) -> tuple[DataFrame, DataFrame]:
    """Entities' terms with the disclosed share (entity, term, share), and the entities of every document."""

    def make():
        def run(cols: dict) -> dict:
            base = [base_spans(t or "") for t in cols["text"]]
            return {
                "_row": cols["_row"],
                "doc_id": cols["doc_id"],
                "base": [[{"kind": k, "start": s, "end": e} for k, s, e in b] for b in base],
                "near": [contexts(t, b) if b else [] for t, b in zip(cols["text"], base, strict=True)],
            }

        return run

    schema = "_row bigint, doc_id bigint, base array<struct<kind:int,start:int,end:int>>, near array<struct<entity:string,term:string,window:bigint,start:int,end:int>>"
    found = saved(arrow_pass(_keyed(docs.select("doc_id", "text")), make, schema, rows=256), "entities")
    near = found.select("_row", F.explode("near").alias("x")).select("_row", "x.*")
    pooled = F.udf(pools, "array<string>", useArrow=False)
    # every pair once a window, with the documents that have it; then windows and documents are counted by plain sums
    windows = near.select("_row", F.explode(pooled("entity")).alias("entity"), "term", "window").distinct()
    pairs = windows.filter("term IS NOT NULL").groupBy("entity", "term", "window").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("together"), F.sum("n").alias("documents")).filter(F.col("together") >= support)
    own = windows.select("entity", "_row").distinct().groupBy("entity").agg(F.count("*").alias("times"))
    pairs = saved(pairs.join(own, "entity"), "pairs")
    n = float(max(2, docs.count()))
    df = _document_counts(docs, pairs.select("term").distinct(), terms_in_task)
    scored = pairs.join(df, "term").withColumn("documents", F.least("documents", "times")).withColumn("df", F.greatest("df", "documents"))
    sure = F.col("documents") / F.col("df") * F.pow(F.lit(1 - SURE), 1 / F.col("together"))
    share = 1 + F.log(sure) / F.log(F.lit(n) / F.least(F.col("times"), F.lit(n / 2)))
    return saved(scored.withColumn("share", share).filter(F.col("share") >= generalise).select("entity", "term", "share"), "telling"), found


def scan(docs: DataFrame, **options) -> DataFrame:
    """Base spans and all spans (kind, start, end, share: the disclosed share of a term) of every document."""

    def emit(cols: dict, base: list, marks: list) -> dict:
        return {"doc_id": cols["doc_id"], "base": base, "all": marks}

    return _marked(docs.select("doc_id", "text"), emit, f"doc_id bigint, base array<struct<kind:int,start:int,end:int>>, all {_ALL}", **options)


_ALL = "array<struct<kind:int,start:int,end:int,share:double>>"


def _mark(text: str, base: list, shares: dict[str, float]) -> list[dict]:
    """Base spans, then all places of the terms of ``shares`` outside of them."""
    out = [x | {"share": None} for x in base]
    if shares:
        cover = Cover((x["start"], x["end"]) for x in base)
        for m in _terms(text):
            share = shares.get(m.group().lower())
            if share is not None and not cover.touches(m.start(), m.end()):
                out.append({"kind": 4, "start": m.start(), "end": m.end(), "share": share})
    return out


def _marked(docs: DataFrame, emit: Callable[[dict, list, list], dict], schema: str | StructType, terms_in_task: int = TERMS_IN_TASK, **options) -> DataFrame:
    """What ``emit`` makes of each row of docs, its base spans and all its spans.

    Telling terms are looked up in every task, or by joins on the term where they are many.
    """
    telling, found = telling_terms(docs, terms_in_task=terms_in_task, **options)

    def bases(texts: list[str | None]) -> list:
        return [[{"kind": k, "start": s, "end": e} for k, s, e in base_spans(t or "")] for t in texts]

    if telling.limit(terms_in_task + 1).count() <= terms_in_task:
        by_term: dict[str, dict[str, float]] = {}
        for r in telling.collect():  # terms_in_task rows at most
            by_term.setdefault(r["term"], {})[r["entity"]] = r["share"]
        everywhere = {t: max(e.values()) for t, e in by_term.items() if max(e.values()) >= REMOVE}
        by_entity: dict[str, dict[str, float]] = {}
        for t, e in by_term.items():
            for k, share in e.items():
                by_entity.setdefault(k, {})[t] = share

        def make():
            def run(cols: dict) -> dict:
                base, marks = bases(cols["text"]), []
                for t, own in zip(cols["text"], base, strict=True):
                    shares = everywhere
                    for k in {k for x in own for k in pools(entity_of(t, x["kind"], x["start"], x["end"]))} & by_entity.keys():
                        shares = shares | {w: max(x, shares.get(w, x)) for w, x in by_entity[k].items()}
                    marks.append(_mark(t or "", own, shares))
                return emit(cols, base, marks)

            return run

        return arrow_pass(docs, make, schema, rows=256)

    def make_words():
        def run(cols: dict) -> dict:
            pairs = [(r, d, w) for r, d, t in zip(cols["_row"], cols["doc_id"], cols["text"], strict=True) if t for w in {m.group().lower() for m in _terms(t)}]
            return dict(zip(("_row", "doc_id", "term"), zip(*pairs, strict=True) if pairs else ([],) * 3, strict=True))

        return run

    rows = _keyed(docs.select("doc_id", "text"))
    words = arrow_pass(rows, make_words, "_row bigint, doc_id bigint, term string", rows=256).join(telling.select("term").distinct(), "term", "left_semi").distinct()
    words = saved(words, "words")
    pooled = F.udf(pools, "array<string>", useArrow=False)
    named = found.select("_row", F.explode(F.transform("near", lambda x: x["entity"])).alias("name")).distinct().select("_row", F.explode(pooled("name")).alias("entity")).distinct()
    local = words.join(named, "_row").join(telling, ["entity", "term"]).select("_row", "doc_id", "term", "share")
    wide = telling.groupBy("term").agg(F.max("share").alias("share")).filter(F.col("share") >= REMOVE)
    shares = local.unionByName(words.join(wide, "term").select("_row", "doc_id", "term", "share")).groupBy("_row", "doc_id", "term").agg(F.max("share").alias("share"))
    shares = shares.groupBy("_row", "doc_id").agg(F.collect_list(F.struct("term", "share")).alias("shares"))  # within one text
    own = "_shares"
    while own in docs.columns:
        own = f"_{own}"
    shares = shares.select(F.col("_row").alias(f"{own}_r"), F.col("doc_id").alias(f"{own}_d"), F.col("shares").alias(own))
    same = (F.xxhash64(docs["text"], docs["doc_id"]) == F.col(f"{own}_r")) & docs["doc_id"].eqNullSafe(F.col(f"{own}_d"))

    def make_marks():
        def run(cols: dict) -> dict:
            base = bases(cols["text"])
            marks = [_mark(t or "", b, {x["term"]: x["share"] for x in s or []}) for t, b, s in zip(cols["text"], base, cols[own], strict=True)]
            return emit(cols, base, marks)

        return run

    return arrow_pass(docs.join(shares, same, "left"), make_marks, schema, rows=256)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with base spans replaced by their kind, telling terms generalised to a word class or removed."""

    def emit(cols: dict, base: list, marks: list) -> dict:
        texts = []
        for t, found in zip(cols["text"], marks, strict=True):
            parts, at = [], 0
            for x in sorted(found, key=lambda x: (x["start"], x["kind"])):
                if x["start"] < at:
                    continue
                own = t[x["start"] : x["end"]]
                new = f"[{KINDS[x['kind']].upper()}]" if x["kind"] < 4 else "" if x["share"] >= REMOVE else "[NAME]" if own[0].isupper() else "[WORD]"
                parts += [t[at : x["start"]], new]
                at = x["end"]
            texts.append("".join([*parts, t[at:]]) if parts else t)
        return cols | {"text": texts}

    return _marked(docs, emit, docs.schema, **options)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")), KINDS, 4, by_kind=True)
