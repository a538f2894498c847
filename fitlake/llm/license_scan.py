"""Licence scans by sentence rules.

``license_texts`` holds whole licence texts and notices. They are cut into sentences, and each sentence,
normalised to its words (lower case, without punctuation, comment signs, numbering and line ends), gets an
identifier; equal sentences of several licences share one. A text is normalised to words in the same way,
and read from left to right: where a known sentence begins, the longest that fits is taken, wherever it
stands (a long one is also known by its opening). Three more kinds of identifiers come from grammars of
words: a licence that is named in a phrase ("licensed under the ..."), one that is named by a line of its
own, and one in an SPDX line; and two stand for copyright lines.

The identifiers, in the order of the text, are then matched against ordered rules: whole texts, notices,
names. A rule names the sentences that follow one another; some of them may be missing, and others or
unknown words may stand between. The first rule that fits takes them out of the sequence. What no rule
takes stays as unmatched identifiers. Labels are SPDX names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentences of fewer words say too little to be known.
SHORTEST = 6
#: A sentence of more words is also known by its opening of so many.
OPENING = 16
#: Words in a title, at most.
TITLE_WORDS = 14
#: Words between two sentences of one licence, at most.
MAX_GAP = 200

#: Rules of whole texts in the order in which they are tried: label, file, words of sentences that must be
#: there, and the share of its sentences that must be found.
TEXT_RULES = [
    ("GPL-3.0-only", "GPL-3.0", (), 0.5),
    ("GPL-2.0-only", "GPL-2.0", (), 0.5),
    ("GPL-1.0-only", "GPL-1.0", (), 0.5),
    ("LGPL-2.1-only", "LGPL-2.1", (), 0.5),
    ("LGPL-3.0-only", "LGPL-3.0", (), 0.5),
    ("MPL-2.0", "MPL-2.0", (), 0.5),
    ("MPL-1.1", "MPL-1.1", (), 0.5),
    ("Apache-2.0", "Apache-2.0", (), 0.5),
    ("CC0-1.0", "CC0-1.0", (), 0.5),
    ("Artistic-1.0-Perl", "Artistic-1.0-Perl", (), 0.5),
    ("BSD-4-Clause", "BSD-4-Clause", ("all advertising materials", "redistributions in binary form"), 0.5),
    ("BSD-3-Clause", "BSD-3-Clause", ("names of its contributors", "redistributions in binary form"), 0.5),
    ("BSD-2-Clause", "BSD-2-Clause", ("redistributions in binary form",), 0.5),
    ("BSL-1.0", "BSL-1.0", ("prepare derivative works",), 0.3),
    ("MIT", "MIT", ("furnished to do so",), 0.5),
    ("ISC", "ISC", ("hereby granted",), 0.3),
    ("0BSD", "0BSD", ("hereby granted",), 0.6),
    ("Zlib", "Zlib", ("alter it and redistribute it",), 0.4),
    ("Unlicense", "Unlicense", ("free and unencumbered",), 0.1),
]
#: Rules of notices: label (None: what the first identifier names), identifier or file, share.
NOTICE_RULES = [
    ("Apache-2.0", "Apache-2.0.notice", 0.4),
    ("MPL-2.0", "MPL-2.0.notice", 0.5),
    (None, "gnu", 0.0),
    (None, "spdx", 0.0),
    (None, "named", 0.0),
    (None, "title", 0.0),
]
#: Identifiers that never end a licence, and that no rule takes.
PASSED_OVER = {"copyright", "all_rights"}

_WORD = re.compile(r"[a-z0-9]+(?:[.'’/_-]+[a-z0-9]+)*\+?")
_STOP = re.compile(r"[.!?;:][\"')\]]*(?=\s|\Z)|\n[ \t]*\n|\{\{.*?\}\}|[.!?;:]?\s+(?=\(?[0-9a-z]{1,3}[.)]\s)")
#: A copyright statement has no stop: it starts with its line and ends with the line of its year.
_COPYRIGHT_LINE = re.compile(
    r"^[^\w\n]*(?:(?:dnl|rem)\b[^\w\n]*)?copyright\W{1,20}(?:c\W{1,20})?[0-9]{4}[^\r\n]*", re.IGNORECASE | re.MULTILINE
)
_HINT = re.compile(r"licen[sc]|copyright|redistribut|warrant|liable|permission|released|distributed|public domain|reserved")

_GPL_VERSION = (
    r"(?: license)?(?: version| ver| v)?[ -]?v?(?P<v>[123](?:\.[01])?)"
    r"(?: of the license)?(?P<later>\+|-or-later| or(?: at your option)?(?: any)? (?:later|newer|greater)(?: versions?)?)?(?:[ -]only)?"
)
_GPL_KIND = r"(?:(?:gnu )?(?P<kind>lesser |library |affero )?general public license|(?:gnu )?(?P<short>[al]?gpl))"
#: How a licence is named: pattern over normalised words, and its label.
NAMES = [
    (r"(?:(?:mit|expat|x11)(?:[ /]x11)?)(?: license)?", "MIT"),
    (r"apache(?: software)?(?: license)?(?: version| v)?[ -]?v?2(?:\.0)?(?: license)?", "Apache-2.0"),
    (rf"version (?P<first>[123](?:\.[01])?)(?P<first_later> or any later version)? of the {_GPL_KIND}", "{gpl}"),
    (_GPL_KIND + _GPL_VERSION, "{gpl}"),
    (_GPL_KIND, "{gpl}"),
    (r"(?P<clauses>[234])[ -]clause(?: bsd)?(?: license)?|bsd[ -](?P<clauses2>[234])[ -]clause(?: license)?", "BSD-{clauses}-Clause"),
    (r"(?:new|revised|modified) bsd(?: license)?", "BSD-3-Clause"),
    (r"(?:simplified|freebsd) bsd(?: license)?|freebsd license", "BSD-2-Clause"),
    (r"0bsd|zero[ -]clause bsd(?: license)?", "0BSD"),
    (r"isc(?: license)?", "ISC"),
    (r"(?:mozilla public license|mpl)(?: version| v)?[ -]?v?(?P<mpl>1\.1|2\.0|2)", "MPL-{mpl}"),
    (r"(?:eclipse public license|epl)(?: version| v)?[ -]?v?(?P<epl>[12]\.0)", "EPL-{epl}"),
    (r"(?:european union public license|eupl)(?: version| v)?[ -]?v?(?P<eupl>1\.[12])", "EUPL-{eupl}"),
    (r"boost software license(?: version| v)?(?: 1\.0)?|bsl-1\.0", "BSL-1.0"),
    (r"zlib(?:/libpng)?(?: license)?", "Zlib"),
    (r"(?:the )?unlicense", "Unlicense"),
    (r"(?:creative commons )?(?:cc0|cc-0|cc zero)(?:[ -]1\.0)?(?: universal)?(?: license)?", "CC0-1.0"),
    (
        r"(?:creative commons )?(?:cc[ -])?(?:by|attribution)(?P<nc>[ -](?:nc|non-?commercial))?"
        r"(?:[ -](?P<sa>sa|share-?alike)|[ -](?P<nd>nd|no-?deriv(?:ative)?s?))?(?: license)?(?: version| v)?[ -]?(?P<cc>[1234]\.[05])"
        r"(?: international| unported| generic)?(?: license)?",
        "CC-BY{nc}{sa}{nd}-{cc}",
    ),
    (r"artistic license(?: version| v)?[ -]?2\.0|artistic-2\.0", "Artistic-2.0"),
    (r"wtfpl|do what the fuck you want to public license", "WTFPL"),
    (r"postgresql license", "PostgreSQL"),
    (r"python software foundation license", "PSF-2.0"),
]
_ONE_NAME = re.compile("|".join(f"(?P<n{i}>{re.sub(r'[(][?]P<\w+>', '(?:', p)})(?![\\w.+-])" for i, (p, _) in enumerate(NAMES)))
_NAMES = [(re.compile(p), label) for p, label in NAMES]
_ANY = _ONE_NAME.pattern.replace("?P<n", "?P<name")
_VERB = (
    r"(?:licensed|released|distributed|redistributed|available|provided|published|offered|shared|covered|dedicated|used|modified)"
    r"(?: and(?:/or)? \w+)?(?: to the public domain)?(?: only)?"
)
_PHRASE = re.compile(
    rf"\b{_VERB} (?:under|by)(?: either)?(?: the| a| an)?(?: terms(?: and conditions)? of(?: the| a| an)?)? (?P<whole>{_ANY})"
    rf"(?: as published by the free software foundation(?: either)? version {_GPL_VERSION.split('[ -]?v?')[1].replace('?P<v>', '?P<pv>').replace('?P<later>', '?P<plater>')})?"
)
_GNU = re.compile(
    r"\b(?:is|are) free software you (?:can|may) redistribute it and/or modify it under the terms of "
)
_ALSO = re.compile(rf"(?: and| or)(?: the)? (?P<whole>{_ANY})")
_TITLE = re.compile(
    rf"(?P<of>(?:this \w+ )?license (?:is )?)?(?:the )?(?P<whole>{_ANY})(?: license)?(?: agreement)?(?: mit| bsd)?(?: (?:\d{{1,2}} )?(?:january|february|june|november) \d{{4}})?"
)
_SPDX = re.compile(r"\bspdx-license-identifier (?P<spdx>[\w.+-]+(?: (?:and|or|with) [\w.+-]+)*)")
#: SPDX names whose capitals can't be told from the label of a name; fixed values.
_SPDX_NAMES = [
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0-Perl", "Artistic-2.0",
    "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CDDL-1.0", "Classpath-exception-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-1.0-only",
    "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only",
    "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "Linux-syscall-note",
    "LLVM-exception", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "OFL-1.1", "PostgreSQL", "PSF-2.0", "Python-2.0",
    "Unlicense", "WTFPL", "X11", "Zlib",
]


class Found(NamedTuple):
    """A known sentence in a text: its first and last word, its place in the text, its identifier, what it names."""

    first: int
    last: int
    at: int
    name: str
    label: str


def canonical(expression: str) -> str:
    """An SPDX expression with its names as SPDX writes them; names that aren't known stay as they are."""
    known = {x.lower(): x for x in _SPDX_NAMES}
    for x in list(known):  # names without -only, and those with a plus sign, are older spellings
        if x.endswith("-only"):
            known[x.removesuffix("-only")] = known[x]
            known[x.removesuffix("-only") + "+"] = known[x].replace("-only", "-or-later")
    parts = [x.upper() if x.lower() in ("and", "or", "with") else known.get(x.lower(), x) for x in expression.split()]
    return " ".join(parts)


def _version(text: str) -> str:
    return text if "." in text else f"{text}.0"


def label_of(words: str) -> str | None:
    """The SPDX name of a licence that is named by normalised words, else None."""
    for pattern, label in _NAMES:
        found = pattern.fullmatch(words)
        if not found:
            continue
        got = defaultdict(str, {k: v or "" for k, v in found.groupdict().items()})
        if label == "{gpl}":
            kind = (got["kind"][:1] if got["kind"] else got["short"][:-3]).upper()
            version = got["v"] or got["first"]
            later = got["later"] or got["first_later"]
            if not version:
                return f"{kind}GPL-1.0-or-later" if not kind else f"{kind}GPL-{'2.0' if kind == 'L' else '3.0'}-or-later"
            return f"{kind}GPL-{_version(version)}-{'or-later' if later else 'only'}"
        got["clauses"] = got["clauses"] or got["clauses2"]
        got["mpl"] = _version(got["mpl"]) if got["mpl"] else ""
        for key in ("nc", "sa", "nd"):
            got[key] = got[key] and f"-{key.upper()}"
        return label.format_map(got)
    return None


def words_of(text: str) -> list[tuple[str, int]]:
    """The normalised words of a text, and where each begins."""
    lowered = text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = ((m[0], m.start()) for m in _WORD.finditer(lowered))
    return [(w.replace("’", "'").replace("licence", "license").removesuffix("'s"), at) for w, at in found]


def cut_sentences(text: str) -> Iterator[tuple[str, ...]]:
    """The sentences of a licence text as words, without numbering, titles, what phrases tell, and those that say too little."""
    for part in _STOP.split(text):
        words = [w for w, _ in words_of(part)]
        while words and (len(words[0]) <= 2 and words[0] not in ("a", "if", "in", "by", "no", "we", "to", "as", "or", "it", "do") or words[0].isdigit()):
            del words[0]
        joined = " ".join(words)
        told = "as published by the free software" in joined or joined.startswith("either version") or _TITLE.fullmatch(joined)
        if len(words) >= SHORTEST and not told:
            yield tuple(words)


class Knowledge:
    """The known sentences by their first words, and the rules."""

    def __init__(self, texts: dict[str, str]):
        names: dict[tuple[str, ...], str] = {}
        sequences = {}
        wanted = [f for _, f, *_ in TEXT_RULES] + [f for _, f, _ in NOTICE_RULES if f in texts] + ["GNU.notice"]
        for name in wanted:
            sequences[name] = [
                names.setdefault(s, f"{name}/{k}") for k, s in enumerate(cut_sentences(texts.get(name, "")))
            ]
        said = {name: " ".join(words) for words, name in names.items()}
        self.starts: dict[tuple[str, ...], list[tuple[int, tuple[str, ...], str]]] = defaultdict(list)
        openings: dict[tuple[str, ...], str | None] = {}
        for words, name in names.items():
            self.starts[words[:3]].append((len(words), words, name))
            if len(words) > OPENING:
                opening = words[:OPENING]
                openings[opening] = name if openings.get(opening, name) == name else None
        for words, name in openings.items():
            if name and words not in names:
                self.starts[words[:3]].append((len(words), words, name))
        for known in self.starts.values():
            known.sort(reverse=True)
        #: (label, identifiers in their order, identifiers that must be there, how many are enough)
        self.rules = []
        for label, name, must, share in TEXT_RULES:
            ids = sequences[name]
            needed = {next(x for x in ids if phrase in said[x]) for phrase in must}
            self.rules.append((label, ids, needed, max(1, math.ceil(len(ids) * share))))
        gnu = sequences["GNU.notice"]
        for label, name, share in NOTICE_RULES:
            ids = sequences.get(name, [name])
            least = max(1, math.ceil(len(ids) * share))
            self.rules.append((label, ids + gnu * (name == "gnu"), set() if name in sequences else {name}, least))


@lru_cache(maxsize=1)
def knowledge() -> Knowledge:
    """The knowledge in ``license_texts``, built once in each worker."""
    folder = files(__package__).joinpath("license_texts")
    return Knowledge({x.name.removesuffix(".txt"): x.read_text() for x in folder.iterdir() if x.name.endswith(".txt")})


def identify(text: str, known: Knowledge | None = None) -> list[Found]:
    """The known sentences of a text, in order, none inside another."""
    if not _HINT.search(text.lower()):
        return []
    known = known or knowledge()
    stream = words_of(text)
    words = [w for w, _ in stream]
    places = [at for _, at in stream]
    out: list[Found] = []
    k = 0
    while k < len(words):
        for size, sentence, name in known.starts.get(tuple(words[k : k + 3]), ()):
            if tuple(words[k : k + size]) == sentence:
                out.append(Found(k, k + size - 1, places[k], name, ""))
                k += size - 1
                break
        k += 1
    taken = set()
    for x in out:
        taken.update(range(x.first, x.last + 1))
    joined = " ".join(words)
    offsets = [0]
    for w in words:
        offsets.append(offsets[-1] + len(w) + 1)

    def add(start: int, end: int, name: str, label: str | None) -> None:
        first, last = bisect_left(offsets, start), bisect_left(offsets, end) - 1
        if label and first not in taken:
            taken.update(range(first, last + 1))
            out.append(Found(first, last, places[first], name, label))

    for m in _SPDX.finditer(joined):
        end = m.end()
        if 0 < (line := text.find("\n", places[bisect_left(offsets, m.start())])):  # an expression ends with its line
            end = min(end, offsets[bisect_left(places, line)] - 1)
        add(m.start(), end, "spdx", canonical(joined[m.start("spdx") : end]))
    for m in _GNU.finditer(joined):
        if p := _PHRASE.match("licensed under the terms of " + joined[m.end() : m.end() + 300]):
            add(m.start(), m.end() + p.end() - 28, "gnu", _named(p))
    for m in _PHRASE.finditer(joined):
        add(m.start(), m.end(), "named", _named(m))
        at = m.end()
        while more := _ALSO.match(joined, at):  # "under the X license or the Y license"
            add(more.start() + 1, more.end(), "named", label_of(more["whole"]))
            at = more.end()
    for start, end in _lines(text, places):
        line = joined[offsets[start] : offsets[end] - 1]
        if (m := _TITLE.fullmatch(line)) and (m["of"] or "license" in line or re.search(r"\d", line)):
            add(offsets[start], offsets[end] - 1, "title", label_of(m["whole"]))
    spans = [m.span() for m in _COPYRIGHT_LINE.finditer(text)]
    for start, _ in spans:
        out.append(Found(bisect_left(places, start), bisect_left(places, start), start, "copyright", ""))
    for m in re.finditer(r"\ball rights reserved\b", joined):
        first = bisect_left(offsets, m.start())
        if first not in taken:
            out.append(Found(first, first + 2, places[first], "all_rights", ""))
    return sorted(out, key=lambda x: (x.at, x.name))


def _named(m: re.Match) -> str | None:
    """The label of what a phrase names; a version may follow the publisher."""
    if m["pv"]:
        return label_of(re.sub(r" version.*| v?\d.*", "", m["whole"]) + f" version {m['pv']}" + (" or later" if m["plater"] else ""))
    return label_of(m["whole"])


def _lines(text: str, places: list[int]) -> list[tuple[int, int]]:
    """(first word, end) of each two short lines that follow one another, then of each short line."""
    spans, before, at = [], 0, 0
    for line in text.splitlines(keepends=True):
        at += len(line)
        end = bisect_left(places, at)
        if before < end:
            spans.append((before, end))
        before = end
    pairs = [(a, d) for (a, _), (_, d) in zip(spans, spans[1:], strict=False)]
    return [(a, b) for a, b in pairs + spans if b - a <= TITLE_WORDS]


def match_rules(found: list[Found], known: Knowledge | None = None) -> tuple[list[str], list[str]]:
    """(licences in the order of the text, identifiers that no rule took)."""
    known = known or knowledge()
    left = list(range(len(found)))
    licences: list[tuple[int, int, str, str]] = []
    for label, ids, must, least in known.rules:
        order = {x: i for i, x in reversed(list(enumerate(ids)))}
        gone: set[int] = set()
        for at, start in enumerate(left):
            if start in gone or found[start].name not in order:
                continue
            taken, low = [], 0
            for k in range(at, len(left)):
                x = found[left[k]]
                if taken and x.first - found[taken[-1]].last > MAX_GAP:
                    break
                if left[k] not in gone and order.get(x.name, -1) >= low:
                    taken.append(left[k])
                    low = order[x.name] + 1
                    if low == len(ids):
                        break
            if len(taken) < least or not must <= {found[i].name for i in taken}:
                continue
            licences.append((start, taken[-1], label or found[start].label, ids[0]))
            gone.update(taken)
            if label:  # whatever stands within a licence is part of it
                gone.update(i for i in range(start, taken[-1]) if found[i].name not in PASSED_OVER)
        left = [i for i in left if i not in gone]
    licences.sort()
    out: list[str] = []
    for k, (_, end, label, kind) in enumerate(licences):
        # A title goes with the text below it.
        if kind == "title" and k + 1 < len(licences) and licences[k + 1][2] == label:
            between = {found[i].name for i in range(end + 1, licences[k + 1][0])}
            if between <= PASSED_OVER:
                continue
        out.append(label)
    return out, [found[i].name for i in left]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_ids, licenses, unmatched) of each row: arrays in the order of the text.

    Whole texts are read, whatever their length. Null and empty texts give empty arrays. Rows that repeat an
    id each give a row, null ids stay null. A licence that is found several times is listed as often. Where
    several rules fit, the first one counts. Other columns are not read, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = T.ArrayType(T.StringType())
    schema = T.StructType(
        [source.schema["id"], *(T.StructField(n, words) for n in ("sentence_ids", "licenses", "unmatched"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = identify(text.as_py() or "")
                rows.append(([x.name for x in found], *match_rules(found)))
            columns = [pa.array([r[k] for r in rows], kind) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its licences, how many sentences were known, and how many no rule took."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(",", "licenses").alias("licenses"),
        F.concat_ws(",", "sentence_ids").alias("sentence_ids"),
        F.size("unmatched").cast("long").alias("n_unmatched"),
    )
