"""License scans by ordered signature rules.

A text becomes its words (A-Z lowered, everything of ASCII but letters and digits a gap) joined by one space, so that rules see neither
punctuation nor line breaks, and a place is a number of words. A rule is a regex over that line, the words of which at least
one has to be in the text for the regex to be tried (several such groups have to hold), a label, a weight and a priority.
Detections are taken in order of priority, then length, then start; one that lies within a detection already taken is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import blocks

#: The phrases that always count, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Rule:
    kind: str
    label: str
    pattern: str
    needs: tuple[frozenset, ...]  # of each group one word has to be in the text
    priority: int
    weight: float


#: Kinds of rules: (priority, weight). A smaller priority goes first.
KINDS = {"tag": (1, 1.0), "text": (2, 1.0), "link": (3, 0.9), "grant": (4, 0.95), "name": (5, 0.8), "short": (6, 0.6)}
_GRANTED = "licensed licenced released distributed available published provided dual covered redistributed offered governed use used under"
_BY = r"(?:(?:dual )?licen[sc]ed|released|(?:re)?distributed|available|published|provided|covered|offered|governed|used?)"
GRANT = _BY + r"(?: only)? (?:under|by|with|as|subject to)(?: the)?(?: terms(?: and conditions)?(?: of)?)?(?: the)?(?: version [0-9]+(?: [0-9]+)? of(?: the)?)? "
_NOTICE = frozenset("license licence licensed licenced licenses".split())


def version(number: str) -> str:
    """A version after a name: ``version 3``, ``v3``, ``3 0``, ``3``; also with ``or later`` or ``only``."""
    whole = number.replace(".", " ")
    tail = "(?: 0)?" if " " not in whole else ""
    return rf"(?: version| ver| v)? ?v?{whole}{tail}(?: only| or(?: at your option)?(?: any)? later(?: version)?)?"


#: Hand-written families: label, names as a regex over words, words of which one is in every name, identifiers of tags, pages.
FAMILIES: list[tuple[str, str, str, str, str]] = [
    ("mit", r"(?:the )?(?:mit|expat)(?: x11)?", "mit expat", r"mit", r"opensource org licenses? mit(?: license)?(?: php| html)?|mit license org|choosealicense com licenses mit"),
    ("mit-0", r"mit no attribution|mit 0|mit zero", "mit", r"mit 0", r"opensource org licenses? mit 0"),
    ("isc", r"(?:the )?isc|internet systems consortium", "isc internet", r"isc", r"opensource org licenses? isc"),
    ("x11", r"x11|x consortium", "x11 consortium", r"x11", r"xfree86 org [0-9 ]*license"),
    ("zlib", r"zlib(?: libpng)?|zlib png", "zlib", r"zlib", r"(?:opensource org licenses? zlib|zlib net zlib license)"),
    ("libpng", r"libpng|png reference library", "libpng png", r"libpng(?: 2 0)?", r"libpng org pub png src libpng license"),
    ("curl", r"curl", "curl", r"curl", r"curl (?:se|haxx se) docs copyright"),
    ("ntp", r"ntp", "ntp", r"ntp(?: 0)?", r"opensource org licenses? ntp"),
    ("postgresql", r"postgresql|postgres", "postgresql postgres", r"postgresql", r"postgresql org about licen[sc]e"),
    ("python-2", r"python software foundation|psf|python" + version("2"), "python psf", r"(?:psf|python) 2 0", r"python org psf license|docs python org 3 license"),
    ("ruby", r"ruby", "ruby", r"ruby", r"ruby lang org en about license"),
    ("php-3.01", r"php" + version("3.01"), "php", r"php 3 01", r"php net license 3 01"),
    ("perl-artistic-1", r"(?:perl )?artistic(?: license)?" + version("1"), "artistic", r"artistic 1 0(?: perl)?", r"perlfoundation org artistic license 1 0"),
    ("perl-artistic-2", r"(?:perl )?artistic(?: license)?" + version("2"), "artistic", r"artistic 2 0", r"perlfoundation org artistic license 2 0|opensource org licenses? artistic 2 0"),
    ("unlicense", r"(?:the )?unlicen[sc]e", "unlicense unlicence", r"unlicense", r"unlicense org"),
    ("wtfpl", r"wtfpl(?:" + version("2") + r")?|do what the fuck you want to public", "wtfpl fuck", r"wtfpl", r"wtfpl net|sam zoy org wtfpl"),
    ("0bsd", r"(?:bsd )?zero clause bsd|bsd zero clause|0bsd|free public license 1 0 0", "bsd 0bsd public", r"0bsd", r"opensource org licenses? 0bsd"),
    ("bsd-1", r"bsd 1 clause|one clause bsd|1 clause bsd", "bsd", r"bsd 1 clause", r"opensource org licenses? bsd 1 clause"),
    ("bsd-2", r"bsd 2 clause|two clause bsd|2 clause bsd|simplified bsd|freebsd", "bsd freebsd", r"bsd 2 clause(?: patent| views)?", r"opensource org licenses? bsd 2 clause|freebsd org copyright freebsd license"),
    ("bsd-3", r"bsd 3 clause|three clause bsd|3 clause bsd|new bsd|modified bsd|revised bsd", "bsd", r"bsd 3 clause(?: clear| lbnl)?", r"opensource org licenses? bsd 3 clause"),
    ("bsd-4", r"bsd 4 clause|four clause bsd|4 clause bsd|original bsd|bsd old", "bsd", r"bsd 4 clause(?: uc)?", r"spdx org licenses bsd 4 clause"),
    ("bsd", r"bsd(?: style| like)?|berkeley software distribution", "bsd berkeley", r"bsd", r"opensource org licenses? bsd license(?: php)?"),
    ("apache-1", r"apache(?: software)?(?: foundation)?(?: license)?" + version("1") + "|apache(?: license)?" + version("1.1"), "apache", r"apache 1 [01]", r"apache org licenses license 1 [01](?: txt| html)?"),
    ("apache-2", r"apache(?: software)?(?: foundation)?(?: public)?(?: license)?" + version("2") + "|apl 2(?: 0)?|al2 0", "apache apl al2", r"apache 2 0", r"apache org licenses license 2 0(?: txt| html)?|opensource org licenses? apache 2 0"),
    ("apache", r"apache(?: software)?(?: foundation)?", "apache", r"apache", r"apache org licenses"),
    ("bsl-1", r"boost(?: software)?(?: license)?(?:" + version("1") + ")?", "boost", r"bsl 1 0", r"boost org license 1 0(?: txt)?|boost org users license(?: html)?"),
    ("ms-pl", r"microsoft public|ms pl", "microsoft ms", r"ms pl", r"opensource org licenses? ms pl"),
    ("ms-rl", r"microsoft reciprocal|ms rl", "microsoft ms", r"ms rl", r"opensource org licenses? ms rl"),
    ("afl-3", r"academic free(?: license)?(?:" + version("3") + ")?|afl" + version("3"), "academic afl", r"afl 3 0", r"opensource org licenses? afl 3 0"),
    ("osl-3", r"open software(?: license)?" + version("3") + "|osl" + version("3"), "open osl", r"osl 3 0", r"opensource org licenses? osl 3 0"),
    ("cddl-1", r"common development and distribution(?: license)?(?:" + version("1") + ")?|cddl(?:" + version("1") + ")?", "common cddl", r"cddl 1 [01]", r"opensource org licenses? cddl 1(?: 0)?|sun com cddl"),
    ("cpl-1", r"common public(?: license)?(?:" + version("1") + ")?", "common", r"cpl 1 0", r"opensource org licenses? cpl(?: 1 0)?"),
    ("ipl-1", r"ibm public(?: license)?(?:" + version("1") + ")?", "ibm", r"ipl 1 0", r"opensource org licenses? ibmpl"),
    ("epl-1", r"eclipse public(?: license)?" + version("1") + "|epl" + version("1"), "eclipse epl", r"epl 1 0", r"eclipse org legal epl v10(?: html)?"),
    ("epl-2", r"eclipse public(?: license)?" + version("2") + "|epl" + version("2"), "eclipse epl", r"epl 2 0", r"eclipse org legal epl (?:v20|2 0)(?: html)?"),
    ("edl-1", r"eclipse distribution(?: license)?(?:" + version("1") + ")?", "eclipse", r"edl 1 0", r"eclipse org org documents edl v10(?: php)?"),
    ("mpl-1", r"mozilla public(?: license)?(?:" + version("1.1") + "|" + version("1") + ")|mpl(?:" + version("1.1") + "|" + version("1") + ")", "mozilla mpl", r"mpl 1 [01]", r"mozilla org mpl (?:mpl )?1 [01]"),
    ("mpl-2", r"mozilla public(?: license)?" + version("2") + "|mpl" + version("2"), "mozilla mpl", r"mpl 2 0", r"mozilla org (?:en us )?mpl 2 0"),
    ("eupl-1", r"european union public(?: licen[sc]e)?(?: v?(?:ersion )?1 [0-2])?|eupl(?: v?1 [0-2])?", "european eupl", r"eupl 1 [0-2]", r"joinup ec europa eu [a-z ]*eupl"),
    ("cecill", r"cecill(?: [abc])?(?: v?2(?: [01])?)?", "cecill", r"cecill (?:[bc]|[12](?: [01])?)", r"cecill info licences"),
    ("gfdl", r"gnu free documentation(?: license)?(?: v?(?:ersion )?1 [1-3])?|gfdl(?: v?1 [1-3])?", "documentation gfdl", r"gfdl 1 [1-3](?: (?:only|or later))?", r"gnu org (?:copyleft|licenses) fdl(?: 1 [1-3])?(?: html| txt)?"),
    ("ofl-1.1", r"(?:sil )?open font(?: license)?(?:" + version("1.1") + ")?|ofl(?:" + version("1.1") + ")?", "font ofl", r"ofl 1 1", r"scripts sil org ofl|openfontlicense org"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|cc zero|creative commons zero", "cc0 cc creative", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("pddl", r"public domain dedication and license|open data commons public domain|pddl(?: 1 0)?", "dedication commons pddl", r"pddl 1 0", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("odbl", r"open database(?: license)?(?: 1 0)?|odbl(?: 1 0)?", "database odbl", r"odbl 1 0", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", r"open data commons attribution|odc by(?: 1 0)?", "commons odc", r"odc by 1 0", r"opendatacommons org licenses by(?: 1 0)?"),
    ("cdla-permissive", r"community data(?: license)?(?: agreement)? permissive(?: [12](?: 0)?)?", "community", r"cdla permissive [12] 0", r"cdla (?:dev|io) permissive [12] 0"),
    ("cdla-sharing", r"community data(?: license)?(?: agreement)? sharing(?: 1(?: 0)?)?", "community", r"cdla sharing 1 0", r"cdla (?:dev|io) sharing 1 0"),
    ("openrail", r"(?:creativeml |bigscience )?(?:open ?rail(?: m)?|responsible ai)", "openrail rail responsible", r"openrail", r"huggingface co spaces [a-z]+ license"),
    ("busl-1.1", r"business source(?: license)?(?: 1 1)?|busl(?: 1 1)?", "business busl", r"busl 1 1", r"mariadb com bsl11"),
    ("sspl-1", r"server side public(?: license)?(?:" + version("1") + ")?|sspl(?:" + version("1") + ")?", "server sspl", r"sspl 1 0", r"mongodb com licensing server side public license"),
    ("elastic-2", r"elastic(?: license)?" + version("2"), "elastic", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use|free trial)(?: 1 0 0)?", "polyform", r"polyform [a-z ]+ 1 0 0", r"polyformproject org licenses"),
    ("json", r"json", "json", r"json", r"json org license(?: html)?"),
    ("beerware", r"beer ?ware", "beerware beer", r"beerware", r"people freebsd org phk"),
    ("openssl", r"openssl", "openssl", r"openssl", r"openssl org source license(?: html)?"),
    ("vim", r"vim", "vim", r"vim", r"vimhelp org uganda"),
    ("w3c", r"w3c(?: software)?(?: notice)?", "w3c", r"w3c", r"w3 org consortium legal [0-9a-z ]*copyright software"),
    ("unicode", r"unicode(?: dfs [0-9]{4})?(?: data files and software)?", "unicode", r"unicode(?: dfs [0-9]{4}| 3 0)", r"unicode org (?:copyright|license)(?: html| txt)?"),
    ("qpl-1", r"q public(?: license)?(?:" + version("1") + ")?", "q", r"qpl 1 0", r"opensource org licenses? qtpl"),
    ("lppl-1.3", r"latex project public(?: license)?(?: 1 3[ac]?)?|lppl(?: 1 3[ac]?)?", "latex lppl", r"lppl 1 3[ac]?", r"latex project org lppl"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa", r"ncsa", r"opensource org licenses? (?:uoi )?ncsa"),
    ("upl-1", r"universal permissive(?: license)?(?:" + version("1") + ")?", "universal", r"upl 1 0", r"opensource org licenses? upl"),
    ("blueoak-1", r"blue oak model(?: license)?(?: 1 0 0)?", "oak", r"blueoak 1 0 0", r"blueoakcouncil org license 1 0 0"),
    ("mulan-2", r"mulan (?:psl|permissive software)(?: license)?(?: v?2)?", "mulan", r"mulanpsl 2 0", r"license coscl org cn mulanpsl2"),
    ("imagemagick", r"imagemagick", "imagemagick", r"imagemagick", r"imagemagick org script license(?: php)?"),
    ("sleepycat", r"sleepycat|berkeley db", "sleepycat berkeley", r"sleepycat", r"opensource org licenses? sleepycat"),
]


def _copyleft() -> list[tuple[str, str, str, str, str]]:
    """The general public licenses by kind and version."""
    kinds = {"gpl": (r"gnu (?:general public|gpl)|general public|gpl", "gnu general gpl gplv2 gplv3", "gpl"), "lgpl": (r"gnu (?:lesser|library)(?: general)? public|(?:lesser|library) general public|gnu lgpl|lgpl", "lesser library lgpl lgplv2 lgplv3", "lgpl"), "agpl": (r"gnu affero(?: general)? public|affero general public|affero gpl|gnu agpl|agpl", "affero agpl agplv3", "agpl")}
    out = []
    for label, (name, words, tag) in kinds.items():
        for number in {"gpl": ("1", "2", "3"), "lgpl": ("2", "2.1", "3"), "agpl": ("1", "3")}[label]:
            spelled = number.replace(".", " ")
            dotted = spelled if " " in spelled else f"{spelled} 0"
            out.append((f"{label}-{number}", rf"(?:{name})(?: licen[sc]e)?" + version(number), words, rf"{tag} {dotted}(?: only| or later)?", rf"gnu org (?:copyleft|licenses)(?: old licenses)? {tag} {spelled}(?: 0)?(?: html| txt)?|opensource org licenses? {tag} {dotted}"))
        out.append((label, rf"(?:{name})", words, tag, rf"gnu org (?:copyleft|licenses) {tag}(?: html| txt)?"))
    return out


def _commons() -> list[tuple[str, str, str, str, str]]:
    """The creative commons by elements and version; without one the label has none."""
    spelled = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    out = []
    for parts in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        code, long = " ".join(parts), " ".join(spelled[p] for p in parts)
        name = rf"cc {code}|creative commons(?: licen[sc]e)? (?:{code}|{long})"
        label = "cc-" + "-".join(parts)
        for number in ("2.0", "2.5", "3.0", "4.0"):
            n = number.replace(".", " ")
            out.append((f"{label}-{number}", rf"(?:{name})(?: international| unported| generic)?(?: licen[sc]e)?(?: version)? v?{n}(?: international| unported| generic)?", "cc creative", rf"cc {code} {n}", rf"creativecommons org licenses {code} {n}"))
        out.append((label, rf"(?:{name})(?: international| unported| generic)?", "cc creative", rf"cc {code}", rf"creativecommons org licenses {code}"))
    return out


#: Sentences of license texts and notices: label, regex over words, words of which one each has to be there.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby obtaining"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "hereby fee"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution forms"),
    ("bsd-3", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", "neither endorse"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment", "advertising mentioning"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "implied liable"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable basis"),
    ("apache-2", r"you may not use this file except in compliance with the license", "compliance except"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute gnu"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute gnu"),
    ("agpl", r"under the terms of the gnu affero general public license as published by the free software foundation", "affero published"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla form"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse accompanying"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered domain"),
    ("cc0", r"to the extent possible under law (?:[^ ]+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights", "waived neighboring"),
    ("bsl-1", r"boost software license version 1 0 august 17th 2003", "boost august"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "verbatim everyone"),
    ("public-domain", r"(?:placed|released|dedicated|is) (?:in|into|to) the public domain", "domain"),
    ("all-rights-reserved", r"all rights reserved", "reserved"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)|unauthorized (?:copying|reproduction|distribution) of (?:[^ ]+ ){1,8}is strictly prohibited", "proprietary unauthorized"),
]


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern; those of a group that is all of it, too."""
    if pattern.startswith("(?:") and pattern.find(")") == len(pattern) - 1:
        pattern = pattern[3:-1]
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def rules() -> tuple[Rule, ...]:
    """All rules; each family gives one of every kind: a tag, a link, a grant, a name with the word license, and its bare full name where that has a version."""
    out: list[Rule] = []

    def add(kind: str, label: str, pattern: str, *needs: Iterable[str]) -> None:
        out.append(Rule(kind, label, pattern, tuple(frozenset(n) for n in needs), *KINDS[kind]))

    for label, name, some, tag, page in [*FAMILIES, *_copyleft(), *_commons()]:
        words = some.split()
        add("tag", label, rf"spdx license identifier (?:[^ ]+ (?:and|or|with) )*{tag}", ["spdx"])
        add("link", label, rf"(?:https? )?(?:www )?(?:{page})", [re.match(r"(?:\(\?:)?([a-z0-9]+)", x)[1] for x in _alternatives(page)])
        add("grant", label, rf"{GRANT}(?:{name})(?: (?:open source )?licen[sc]es?)?", words, _GRANTED.split())
        add("name", label, rf"(?:{name}) (?:open source |software |public )?licen[sc]e|licen[sc]e (?:{name})", words, _NOTICE)
        if label[-1].isdigit() or label in ("wtfpl", "0bsd", "cc0"):
            add("short", label, rf"(?:{name})", words)
    for label, pattern, some in TEXTS:
        add("text", label, pattern, *([w] for w in some.split()))
    return tuple(out)


RULES = rules()


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


_TABLE = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text: runs of ASCII letters (lowered), digits, and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Taken:
    """Intervals taken so far; of nested ones the outer is enough, so they lie in order of both ends."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.ends[at - 1] >= end

    def add(self, start: int, end: int) -> None:
        at = bisect_right(self.starts, start)
        stop = at
        while stop < len(self.ends) and self.ends[stop] <= end:
            stop += 1
        while at > 0 and self.starts[at - 1] == start:
            at -= 1
        self.starts[at:stop], self.ends[at:stop] = [start], [end]


class Scanner:
    def __init__(self, all_rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, _compiled(r.pattern)) for r in all_rules]
        self.base = [(label, _compiled(phrase), phrase.count(" ") + 1, frozenset(phrase.encode().split())) for phrase, label in BASE]
        self.needs = [tuple(frozenset(w.encode() for w in group) for group in r.needs) for r in all_rules]
        self.known = frozenset().union(*(g for n in self.needs for g in n), *(w for *_, w in self.base))
        self.by_word: dict[bytes, list[int]] = {}
        for i, groups in enumerate(self.needs):
            for w in groups[0]:
                self.by_word.setdefault(w, []).append(i)

    def tried(self, there: frozenset | set) -> list[int]:
        """Rules whose needed words are in the text."""
        some = {i for w in there for i in self.by_word.get(w, ())}
        return sorted(i for i in some if all(not g.isdisjoint(there) for g in self.needs[i]))

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple]]:
        """Number of words; (label, first word) of each base place; the method's (label, kind, first word, end, weight) that no other holds."""
        words = words_of(text)
        there = self.known.intersection(words)
        tried = self.tried(there)
        based = [b for b in self.base if b[3] <= there]
        if not tried and not based:
            return len(words), [], []
        line = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        place = lambda at: int(np.searchsorted(gaps, at))
        base = sorted((place(m.start()), label) for label, regex, _, _ in based for m in regex.finditer(line))
        found = []
        for i in tried:
            rule, regex = self.rules[i]
            found += [(rule.priority, place(m.start()) - place(m.end() - 1) - 1, place(m.start()), i) for m in regex.finditer(line)]
        taken, kept = Taken(), []
        for _, size, start, i in sorted(found):
            if not taken.holds(start, start - size):
                taken.add(start, start - size)
                rule = self.rules[i][0]
                kept.append((start, start - size, rule.label, rule.kind, rule.weight))
        return len(words), [(label, at) for at, label in base], [(label, kind, a, b, w) for a, b, label, kind, w in sorted(kept)]


_shared: list[Scanner] = []


def scanner() -> Scanner:
    """One a worker process."""
    if not _shared:
        _shared.append(Scanner())
    return _shared[0]


_SPOT = pa.struct([("label", pa.string()), ("start", pa.int64())])
_FOUND = pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())])
SCHEMA = "doc_id long, n_words long, base array<struct<label:string,start:long>>, found array<struct<label:string,kind:string,start:long,end:long,weight:double>>"


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: its number of words, the places of the base phrases, and the detections that no other suppresses; places in words, ends exclusive.

    A null or empty text has no words; null and repeated keys are passed on. Texts of any length are read whole, a block of some MB at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                told = [scanner().scan(t or "") for t in block.column(1).to_pylist()]
                base = [[{"label": k, "start": a} for k, a in b] for _, b, _ in told]
                found = [[dict(zip(("label", "kind", "start", "end", "weight"), x, strict=True)) for x in f] for _, _, f in told]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([n for n, _, _ in told], pa.int64()), pa.array(base, pa.list_(_SPOT)), pa.array(found, pa.list_(_FOUND))], ["doc_id", "n_words", "base", "found"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """``find_licenses`` as one line a document: counts, labels (distinct, sorted, comma-joined), the surest detection's weight as score; a base phrase counts 0.9."""
    starts = F.transform("base", lambda b: b["start"])
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda x: x["label"]) for c in columns)))), ",")
    weight = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["label"], x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "found").alias("labels"), weight.alias("score"), spans.alias("detections"),
    )
