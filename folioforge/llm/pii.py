"""PII by information-theoretic sanitisation.

Protected entities (e-mail and IP addresses, card and phone numbers) are found by pattern. Then the corpus says which
terms give an entity away: within `window` words of the same line, term t and entity e are seen together in k(t, e)
distinct contexts, and t stands n(t) times in the whole corpus. Evidence and share are told apart. The share is the lower
end of Wilson's interval for P(e | t) = k / n(t) at `z` (1.2816: right nine times in ten), which is 0.38 for a term met
once and beside e, 0.55 for one met twice, and rises with every further context. The evidence is the bits that the
contexts give together, k * log2(share / P(e)), where P(e) is the share of all term places that are near e. A pair with a
share of at least `least_share` and at least `least_bits` times the entity's own information -log2(P(e)) is a disclosure:
the term is generalised wherever it stands in the corpus. The bits of one context stay below the entity's own, so a word
that stands once in the corpus discloses nothing. Contexts count once however often a text is copied, in k, in n(t) and in P(e).

Counts cover the whole corpus: terms are counted in each worker and summed by term, a pair's contexts are combined by key.
Terms all of whose places are near their entity need no search. The others are looked up in every text: while they are few
(`BROADCAST_TERMS` and `BROADCAST_CHARS`) they are sent to the workers, beyond that texts' distinct terms are joined to them.

Rows: null and empty texts hold nothing; a null or repeated doc_id is a row like any other; repeated rows count once; extra
columns are kept by `sanitise` and dropped by `find_pii`; an empty table gives an empty one. Texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, fresh_name, own_tables, small_batches, snapshot, texts_of

KINDS = ("email", "ip", "card", "phone")
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[REDACTED]"}
WINDOW, LEAST_SHARE, LEAST_BITS, Z = 6, 0.25, 1.0, 1.2816
COUNTER_WORDS = 300_000
BROADCAST_TERMS, BROADCAST_CHARS = 200_000, 4_000_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Where a run of digits fails, so does every later start in it: the look-behind finds the same matches without retrying.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; found from each @, so that a long run without one costs nothing."""
    out, free, i = [], 0, text.find("@")
    while i >= 0:
        before = text[max(free, text.rfind("@", 0, i) + 1) : i]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, i) if local else None
        if m:
            out.append((i - local, m.end()))
            free = m.end()
        i = text.find("@", max(i + 1, free))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Kind -> (start, end) in code points."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def normal_entity(kind: str, value: str) -> str:
    """One name for the ways of writing an entity."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:" + re.sub("[^0-9]", "", value)


def outside(words: list[re.Match], spans: list[tuple]) -> list[bool]:
    """Which of the words, in order, meet none of the (start, end, ...) spans, in order of start."""
    out, k, reach = [], 0, 0
    for m in words:
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        out.append(reach <= m.start())
    return out


def contexts(text: str, window: int = WINDOW) -> Iterator[tuple[str, str, int, int, int, int, int]]:
    """(entity, term, start, end, hash of the context, new, times) for each term near an entity: the `window` words on either side
    in the same line, however far they are. A word that an entity cuts is none.

    new is 1 at the first mention of the entity that a place is near, else 0; times are the new places of the term at this mention.
    """
    import xxhash

    spans = sorted((a, b, k) for k, x in base_spans(text).items() for a, b in x)
    told: set[tuple[str, int]] = set()
    stop, words = -1, []
    for a, b, k in spans:
        if a > stop:  # a new line: its words once, whatever number of entities it has
            stop = text.find("\n", b)
            stop = len(text) if stop < 0 else stop
            start = text.rfind("\n", 0, a) + 1
            words = list(_TERM.finditer(text, start, stop))
            free = outside(words, spans[bisect_left(spans, (start,)) : bisect_left(spans, (stop,))])  # no span has a line end
        first = bisect_right(words, a, key=re.Match.end)
        last = bisect_left(words, b, key=re.Match.start)
        near = [*range(max(0, first - window), first), *range(last, min(len(words), last + window))]
        h = xxhash.xxh3_64_intdigest(" ".join(words[i][0].lower() for i in near)) - (1 << 63)
        entity = normal_entity(k, text[a:b])
        places = [(words[i][0].lower(), *words[i].span()) for i in near if free[i]]
        new = {x for _, x, _ in places if (entity, x) not in told}
        times = Counter(t for t, x, _ in places if x in new)
        told.update((entity, x) for x in new)
        for t, x, y in places:
            yield entity, t, x, y, h, int(x in new), times[t]


def row_key(docs: DataFrame) -> Column:
    """The same for repeated rows only, so that spans go to the text they were found in: the id and a hash of the text."""
    return F.concat_ws(":", F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("-")), F.xxhash64(docs["text"]).cast("string")).alias("key")


def context_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, entity, term, start, end, context, new, times): the terms near entities; key is the row's, by doc_id and text."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("key", pa.string()), ("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("context", pa.int64()), ("new", pa.int64()), ("times", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("pii")
        wrap = batches(schema)
        for b in parts:
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))) for x in contexts(t, window)]
            yield wrap([list(c) for c in zip(*rows)] if rows else [[] for _ in schema])

    return docs.select(row_key(docs), "text").mapInArrow(run, "key string, entity string, term string, start long, end long, context long, new long, times long")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): how often each term stands in the whole corpus, counted in the workers before it is summed; '' has the sum of all."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def lowered(counts: Counter) -> Iterator[list[list]]:
        """Empties counts, so that words are not held twice."""
        low: Counter = Counter()
        low[""] = sum(counts.values())
        while counts:
            word, n = counts.popitem()
            low[word.lower()] += n
        while low:
            yield [list(x) for x in zip(*(low.popitem() for _ in range(min(50_000, len(low)))))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("pii")
        wrap, counts = batches(schema), Counter()
        for b in parts:
            for t in texts_of(b.column(0)):
                counts.update(_TERM.findall(t))
                if len(counts) > COUNTER_WORDS:  # after each text: a batch of long texts may hold millions of words
                    yield from map(wrap, lowered(counts))
                    counts = Counter()
        yield from map(wrap, lowered(counts))

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lower_share(k: Column, n: Column, z: float = Z) -> Column:
    """The lower end of Wilson's interval for a share of which k in n were seen."""
    z2, p = z * z, k / n
    return (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosures(rows: DataFrame, docs: DataFrame, least_share: float = LEAST_SHARE, least_bits: float = LEAST_BITS, z: float = Z) -> DataFrame:
    """(entity, term, n_contexts, n_places, share, bits, elsewhere) of the pairs that disclose; elsewhere: the term has places not near the entity."""
    distinct = rows.groupBy("entity", "term", "context").agg(F.sum("new").alias("places"), F.max("times").alias("once"))
    pairs = distinct.groupBy("entity", "term").agg(F.count("*").alias("n_contexts"), F.sum("places").alias("near"), F.sum("once").alias("once"))
    # The row of no entity brings the sum of all counts along.
    whole = docs.sparkSession.createDataFrame([("", "", 0, 0, 0)], "entity string, term string, n_contexts long, near long, once long")
    judged = snapshot(pairs.unionByName(whole).join(term_counts(docs), "term"))
    total = judged.where("entity = ''").select("n").first()
    per_entity = judged.where("entity <> ''").groupBy("entity").agg(F.sum("once").alias("n_entity"))
    n = F.greatest(F.lit(1.0), (F.col("n") - F.col("near") + F.col("once")).cast("double"))
    k, p = F.least(F.col("n_contexts").cast("double"), n), F.col("n_entity") / F.lit(float(max(1, total[0] if total else 0)))
    share = lower_share(k, n, z)
    judged = judged.join(per_entity, "entity")
    judged = judged.select("entity", "term", "n_contexts", n.cast("long").alias("n_places"), share.alias("share"), (k * F.log2(share / p)).alias("bits"), (-F.log2(p)).alias("own"), (F.col("n") > F.col("near")).alias("elsewhere"))
    return judged.where((F.col("share") >= least_share) & (F.col("bits") >= least_bits * F.col("own"))).drop("own")


def terms_of_rows(docs: DataFrame, wide: DataFrame) -> DataFrame:
    """(key, term) for every row that holds a term of `wide`; the distinct terms of each text move, not the texts."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("key", pa.string()), ("term", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for b in parts:
            keys, words = [], []
            for key, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                found = {w.lower() for w in set(_TERM.findall(t))}
                keys += [key] * len(found)
                words += found
            yield wrap([keys, words])

    return docs.select(row_key(docs), "text").mapInArrow(run, "key string, term string").join(wide, "term", "left_semi")


def term_spans(docs: DataFrame) -> tuple[DataFrame, frozenset[str] | None]:
    """(term_key, terms array<struct<start,end>>, words array<string>): where disclosing terms stand near their entities, by row
    key, with those to look up in the whole row; and the terms to look up in all rows, or None where words names them by row."""
    rows = snapshot(context_rows(docs))
    told = snapshot(disclosures(rows, docs).select("entity", "term", "elsewhere"))
    near = rows.join(told, ["entity", "term"]).groupBy(F.col("key").alias("term_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    wide = snapshot(told.where("elsewhere").select("term").distinct())
    size = wide.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_TERMS and size["chars"] <= BROADCAST_CHARS:
        return near.withColumn("words", F.array().cast("array<string>")), frozenset(r["term"] for r in wide.collect())
    words = terms_of_rows(docs, wide).groupBy(F.col("key").alias("word_key")).agg(F.collect_set("term").alias("words"))
    both = near.join(words, F.col("term_key") == F.col("word_key"), "full_outer")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return both.select(F.coalesce("term_key", "word_key").alias("term_key"), F.coalesce("terms", empty).alias("terms"), F.coalesce("words", F.array().cast("array<string>")).alias("words")), None


def places_of(text: str, terms: frozenset[str], base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """(start, end) of every place of these terms outside base spans."""
    if not terms or terms.isdisjoint(w.lower() for w in set(_TERM.findall(text))):
        return []
    words = [m for m in _TERM.finditer(text) if m[0].lower() in terms]
    return [m.span() for m, free in zip(words, outside(words, sorted(x for found in base.values() for x in found))) if free]


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, found array<struct<kind,start,end>>): base spans by kind as listed, then start, then terms.

    Texts don't move, unless the terms are too many to be sent to them: then each row's own terms are joined to it.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms, wide = term_spans(docs)
    by_row = wide is None
    shared = docs.sparkSession.sparkContext.broadcast(wide)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    place = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("base", pa.list_(struct)), ("more", pa.list_(place))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for b in parts:
            found, more = [], []
            words = b.column(3).to_pylist() if by_row else None
            for i, t in enumerate(texts_of(b.column(2))):
                base = base_spans(t)
                found.append([{"kind": k, "start": x, "end": y} for k, spans in base.items() for x, y in spans])
                more.append([{"start": x, "end": y} for x, y in places_of(t, frozenset(words[i] or ()) if by_row else shared.value, base)])
            yield wrap([b.column(0), b.column(1), found, more])

    rows = narrow.select("doc_id", row_key(narrow), "text")
    if by_row:
        some = terms.where(F.size("words") > 0).select(F.col("term_key").alias("word_key"), "words")
        rows = rows.join(some, F.col("key") == F.col("word_key"), "left").drop("word_key")
    small_batches(docs.sparkSession)
    rows = rows.mapInArrow(run, "doc_id long, key string, base array<struct<kind:string,start:long,end:long>>, more array<struct<start:long,end:long>>")
    rows = rows.join(terms, F.col("key") == F.col("term_key"), "left")
    every = F.array_sort(F.when(F.col("terms").isNull(), F.col("more")).otherwise(F.array_union("terms", "more")))
    return rows.select("doc_id", F.concat("base", F.transform(every, lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).alias("found"))


def pii_digests(findings: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "term")
    s = findings.select("doc_id", "found", base.alias("base"))
    counts = [(F.size("base") - F.size(F.array_remove(F.transform("base", lambda x: x["kind"]), k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return s.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span generalised to its kind; of spans that overlap, the first and longest counts."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[k]]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns kept, with every span generalised in their text."""
    terms, wide = term_spans(docs)
    by_row, shared = wide is None, docs.sparkSession.sparkContext.broadcast(wide)
    key, near, words = (fresh_name(docs, c) for c in ("pii_key", "pii_terms", "pii_words"))
    rows = docs.join(terms.select(F.col("term_key").alias(key), F.col("terms").alias(near), F.col("words").alias(words)), row_key(docs) == F.col(key), "left").drop(key)
    small_batches(docs.sparkSession)
    at, n = docs.columns.index("text"), len(docs.columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column(at).to_pylist()
            for i, (told, own) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                if not texts[i]:
                    continue
                base = base_spans(texts[i])
                spans = [(k, x, y) for k, found in base.items() for x, y in found] + [("term", x["start"], x["end"]) for x in told or ()]
                spans += [("term", x, y) for x, y in places_of(texts[i], frozenset(own or ()) if by_row else shared.value, base)]
                if spans:
                    texts[i] = replaced(texts[i], spans)
            columns = list(b.columns[:n])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:n])

    return rows.mapInArrow(run, docs.schema)
