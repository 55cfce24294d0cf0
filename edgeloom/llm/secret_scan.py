"""Secrets in texts: fixed patterns, and strings that compression finds new.

A candidate near a sensitive word is priced by what it adds to a compressed
frame: zstandard, primed with the corpus's common identifiers, packs the
surroundings with and without it. Words, paths and names repeat something seen
before and cost little; a random key costs nearly all its bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import column_array, query, read, settle, text_or_empty

#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE_LENGTH = 6
#: A run that is too short fails wherever it starts, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that make their line a sensitive context.
SENSITIVE = ("passw", "pwd", "secret", "token", "api", "key", "auth", "cred", "bearer", "private")
CONTEXT = re.compile(rf"(?i:\b\w*(?:{'|'.join(SENSITIVE)})\w*)\W", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A candidate goes on over dots, as the parts of a signed token do.
DOTTED = re.compile(r"(?:\.[A-Za-z0-9+/_=-]{16,})+")
#: The body of a private key, to its END line, or without one as far as its lines of base64 go.
KEY_BLOCK = re.compile(
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:((?:(?!-----BEGIN ).)*?)-----END |((?:\s*[A-Za-z0-9+/=]{16,}(?!\S))+))", re.S
)
IDENTIFIER = re.compile(r"[A-Za-z_]{4,40}")
#: A letter or digit, and what a line ends in whose value stands on the next one.
PRINTED = re.compile(r"[^\W_]")
OPEN_ENDS = tuple(":=|>\\([{\"'`")
#: Characters on either side of a candidate that price it.
AROUND = 512
#: Added bytes per character from which a candidate is new.
NOVELTY = 0.8
#: Identifiers that prime the compressor: the most frequent, at most 80 KB.
DICTIONARY = 2000

SPANS = "array<struct<kind:string,start:int,end:int,value:int,novelty:double>>"


def base_spans(text: str, low: str) -> list[tuple]:
    """``(kind, start, end, value start, None)`` of the fixed patterns, leftmost and apart per kind."""
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [
            ("assign", m.start(), m.end(), m.start(2), None)
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= VALUE_LENGTH
        ]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), None) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start(), None) for m in HEX.finditer(text)]
    return out


def mixed(word: str) -> bool:
    """Letters and digits, or capitals beyond the first letter among small ones."""
    digits = any(c.isdigit() for c in word)
    letters = any(c.isalpha() for c in word)
    inner = word[1:]
    return digits and letters or (any(c.isupper() for c in inner) and any(c.islower() for c in word))


def contexts(text: str, low: str) -> Iterator[tuple[int, int]]:
    """Stretches after sensitive words, apart and in order.

    Each goes from its word to the end of the line, and where nothing printed
    follows on the line, or the line ends in a mark such as ``:``, to the end of
    the next line that has a letter or digit.
    """
    if not any(w in low for w in SENSITIVE):
        return
    line_end = last = done = -1
    open_end = False
    for m in CONTEXT.finditer(text):
        start = m.end() - 1
        if start > line_end:
            begin, line_end = text.rfind("\n", 0, start) + 1, text.find("\n", start)
            line_end = len(text) if line_end < 0 else line_end
            line = text[begin:line_end].rstrip()
            open_end = line.endswith(OPEN_ENDS)
            last = max((x.start() for x in PRINTED.finditer(line)), default=-1) + begin
        end = line_end
        if (open_end or last < start) and done <= line_end and (following := PRINTED.search(text, line_end)):
            end = text.find("\n", following.start())
            end = len(text) if end < 0 else end
        if end > done:
            yield max(start, done), end
            done = end


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Where the bodies of private keys are, white space at either end aside."""
    out = []
    if "PRIVATE KEY" in text:
        for m in KEY_BLOCK.finditer(text):
            body = m[1] if m[1] is not None else m[2]
            start, end = m.span(1 if m[1] is not None else 2)
            start, end = start + len(body) - len(body.lstrip()), end - len(body) + len(body.rstrip())
            if any(mixed(w) for w in CANDIDATE.findall(text, start, end)):
                out.append((start, end))
    return out


def apart(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Sorted starts and ends of the stretches that ``spans`` cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end, *_ in sorted(spans, key=lambda s: s[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def occurrences(text: str, words: dict[str, float]) -> dict[str, list[int]]:
    """Where each word occurs, leftmost and apart, found in one pass over the text."""
    found: dict[str, list[int]] = defaultdict(list)
    if words:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for end, word in automaton.iter(text):
            start = end + 1 - len(word)
            if not found[word] or found[word][-1] + len(word) <= start:
                found[word].append(start)
    return found


def novel_spans(text: str, low: str, taken: list[tuple], packer) -> list[tuple]:
    """Candidates apart from ``taken`` whose added bytes per character reach ``NOVELTY``.

    Bodies of private keys are among them whatever they cost. Copies of a
    candidate after it, and those before it that follow a sensitive word too, do
    not count as seen. Every copy of a reported string is reported.
    """

    def price_of(word: str, before: str, after: str) -> float:
        bare = len(packer.compress((after + before).encode("utf-8", "surrogatepass")))
        full = len(packer.compress((after + before + word).encode("utf-8", "surrogatepass")))
        return (full - bare) / len(word)

    out = [
        ("novel", s, e, s, price_of(text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND])) for s, e in key_blocks(text)
    ]
    taken = taken + out
    found: dict[int, tuple[int, int, int]] = {}  # start of a candidate: its end, and both ends of the dotted run it is in
    for start, end in contexts(text, low):
        at = start
        while (m := CANDIDATE.search(text, at)) and m.start() < end:
            run = DOTTED.match(text, m.end())
            stop = run.end() if run else m.end()
            at = first = m.start()
            while at < stop and (m := CANDIDATE.match(text, at)):
                found.setdefault(at, (m.end(), first, stop))
                at = m.end() + 1
            at = stop
    places: dict[str, list[int]] = {}
    for start, (end, *_) in sorted(found.items()):
        places.setdefault(text[start:end], []).append(start)
    runs: dict[str, float] = {}
    starts, ends = apart(taken)

    def clear(start: int, end: int) -> bool:
        at = bisect_right(ends, start)
        return at == len(ends) or starts[at] >= end

    for start in sorted(found):
        end, first, stop = found[start]
        word = text[start:end]
        if not mixed(word) or not clear(start, end):
            continue
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND].replace(word, "")
        if len(places[word]) > 1:
            low_end = start - len(before)
            for p in reversed(places[word][bisect_left(places[word], low_end) : bisect_left(places[word], start)]):
                before = before[: p - low_end] + before[p - low_end + len(word) :]
        if (price := price_of(word, before, after)) >= NOVELTY:
            run = text[first:stop] if clear(first, stop) else word
            runs[run] = max(price, runs.get(run, 0.0))
    copies = occurrences(text, runs)
    for word, price in sorted(runs.items(), key=lambda x: -len(x[0])):
        for at in copies[word]:
            if clear(at, at + len(word)):
                out.append(("novel", at, at + len(word), at, price))
                here = bisect_left(starts, at)
                starts.insert(here, at)
                ends.insert(here, at + len(word))
    return out


def find_spans(text: str, packer) -> list[dict]:
    low = text.lower()
    base = base_spans(text, low)
    both = base + novel_spans(text, low, base, packer)
    both.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [dict(zip(("kind", "start", "end", "value", "novelty"), s, strict=True)) for s in both]


def packer_of(dictionary: bytes):
    """A level-3 compressor primed with ``dictionary``."""
    import zstandard

    primer = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False)


def identifier_dictionary(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> bytes:
    """The identifiers of sensitive lines that most documents hold, the most frequent last.

    Every document is counted. Identifiers are letters and underscores, so that
    a key copied into many documents does not become a common word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for t in column_array(batch, "text").to_pylist():
                words: set = set()
                for start, end in contexts(t, t.lower()):
                    words.update(IDENTIFIER.findall(t, t.rfind("\n", 0, start) + 1, end))
                counts.update(words)
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())}
            )

    top = (
        docs.select(text_or_empty(text).alias("text"))
        .mapInArrow(run, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(most)
        .collect()
    )
    return " ".join(r["word"] for r in reversed(top)).encode()


def scan(docs: DataFrame, dictionary: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, spans)`` of every row; offsets count code points, ends are exclusive.

    A null or empty text has no spans; equal rows get equal spans each.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    spans = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32()), ("novelty", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packer_of(dictionary)
        for batch in batches:
            found = [find_spans(t, packer) for t in column_array(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], names=["doc_id", "spans"])

    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans {SPANS}"
    )


def mask(docs: DataFrame, dictionary: bytes, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with the value of every span replaced by ``<secret>`` and the length column mended.

    Overlapping spans become one mark; rows without a span come back unchanged,
    null texts too.
    """
    names = docs.columns
    at = names.index(text)
    number = names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packer_of(dictionary)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sizes = batch.column(number).to_pylist() if number is not None else None
            for i, t in enumerate(texts):
                ends = 0
                parts = []
                for s in sorted(find_spans(t, packer), key=lambda s: s["value"]) if t else ():
                    if s["value"] >= ends:
                        parts += [t[ends : s["value"]], "<secret>"]
                    ends = max(ends, s["end"])
                if parts:
                    texts[i] = "".join([*parts, t[ends:]])
                    if sizes is not None and sizes[i] is not None:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if number is not None:
                columns[number] = pa.array(sizes, batch.column(number).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op7_compression_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, with counts and a digest of the fixed patterns' spans."""
    docs = read(spark, sf_dir, "documents")
    found = scan(docs, identifier_dictionary(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with the values of its secrets masked."""
    settle(spark)
    return mask(docs, identifier_dictionary(docs))
