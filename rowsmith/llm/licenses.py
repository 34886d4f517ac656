"""License detection by ordered signature rules.

A text is searched as its words (A-Z in lower case; letters, digits and non-ASCII characters) with one space
between. Hundreds of rules, each a regular expression, a label and a priority, are gated: an expression runs only in texts
that have, of each of the rule's gates, one of the strings. Gates are read off the expression, so that whatever it finds
has them. A find that lies inside a longer one is dropped. Of finds over the same words, and of those that overlap in
part, only that of the highest priority stays, then the longer, then the one that comes first. Three base phrases are
found in all texts and are never dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc"))
#: Parts of many rules' strings, looked for before these.
STEMS = (b"spdx", b"licen", b"copyright", b"creative commons", b"permi", b"redistribut")

#: label; names by which a text calls the license (expressions over words); its SPDX identifier in words. A name counts
#: with a word of licensing beside it, an identifier behind an SPDX tag.
NAMES = r"""
mit; mit|expat|x11; mit
apache-2; apache( software foundation)?( public)?( license)?( version| ?v)? ?2( 0)?|asl ?2( 0)?|al ?2 0; apache 2 0
apache-1.1; apache( software)?( license)?( version| ?v)? ?1 1; apache 1 1
apache-1.0; apache( software)?( license)?( version| ?v)? ?1 0; apache 1 0
bsd-2-clause; (simplified|free|2 clause|two clause) bsd|bsd (2|two) clause|freebsd; bsd 2 clause
bsd-3-clause; (new|modified|revised|3 clause|three clause) bsd|bsd (3|three) clause; bsd 3 clause
bsd-4-clause; (original|old|4 clause|four clause) bsd|bsd (4|four) clause; bsd 4 clause
0bsd; zero clause bsd|0bsd|bsd zero clause|bsd 0 clause; 0bsd
gpl-1; (gnu )?(general public license|gpl)( version| ?v)? ?1( 0)?; gpl 1 0
gpl-2; (gnu )?(general public license|gpl)( version| ?v)? ?2( 0)?; gpl 2 0
gpl-3; (gnu )?(general public license|gpl)( version| ?v)? ?3( 0)?; gpl 3 0
lgpl-2; (gnu )?(library|lesser) general public license( version| ?v)? ?2( 0)?|lgpl( version| ?v)? ?2( 0)?; lgpl 2 0
lgpl-2.1; (gnu )?lesser general public license( version| ?v)? ?2 1|lgpl( version| ?v)? ?2 1; lgpl 2 1
lgpl-3; (gnu )?lesser general public license( version| ?v)? ?3( 0)?|lgpl( version| ?v)? ?3( 0)?; lgpl 3 0
agpl-1; affero general public license( version| ?v)? ?1( 0)?|agpl( version| ?v)? ?1( 0)?; agpl 1 0
agpl-3; (gnu )?affero general public license( version| ?v)? ?3( 0)?|agpl( version| ?v)? ?3( 0)?; agpl 3 0
gfdl-1.1; (gnu )?free documentation license( version| ?v)? ?1 1|gfdl ?1 1; gfdl 1 1
gfdl-1.2; (gnu )?free documentation license( version| ?v)? ?1 2|gfdl ?1 2; gfdl 1 2
gfdl-1.3; (gnu )?free documentation license( version| ?v)? ?1 3|gfdl ?1 3; gfdl 1 3
mpl-1.0; mozilla public license( version| ?v)? ?1 0|mpl( version| ?v)? ?1 0; mpl 1 0
mpl-1.1; mozilla public license( version| ?v)? ?1 1|mpl( version| ?v)? ?1 1; mpl 1 1
mpl-2; mozilla public license( version| ?v)? ?2( 0)?|mpl( version| ?v)? ?2( 0)?; mpl 2 0
epl-1; eclipse public license( version| ?v)? ?1( 0)?|epl( version| ?v)? ?1( 0)?; epl 1 0
epl-2; eclipse public license( version| ?v)? ?2( 0)?|epl( version| ?v)? ?2( 0)?; epl 2 0
edl-1; eclipse distribution license( version| ?v)? ?1( 0)?; edl 1 0
cddl-1.0; common development and distribution license( version| ?v)? ?1 0|cddl( version| ?v)? ?1 0; cddl 1 0
cddl-1.1; common development and distribution license( version| ?v)? ?1 1|cddl( version| ?v)? ?1 1; cddl 1 1
cpl-1; common public license( version| ?v)? ?1( 0)?; cpl 1 0
ipl-1; ibm public license( version| ?v)? ?1( 0)?; ipl 1 0
npl-1.1; netscape public license( version| ?v)? ?1 1; npl 1 1
spl-1; sun public license( version| ?v)? ?1( 0)?; spl 1 0
osl-3; open software license( version| ?v)? ?3( 0)?|osl ?3( 0)?; osl 3 0
afl-3; academic free license( version| ?v)? ?3( 0)?|afl ?3( 0)?; afl 3 0
artistic-1; artistic license( version| ?v)? ?1( 0)?; artistic 1 0
artistic-2; artistic license( version| ?v)? ?2( 0)?; artistic 2 0
bsl-1; boost software license( version| ?v)? ?1( 0)?; bsl 1 0
busl-1.1; business source license( version| ?v)? ?1 1; busl 1 1
sspl-1; server side public license( version| ?v)? ?1( 0)?|sspl; sspl 1 0
elastic-2; elastic license( version| ?v)? ?2( 0)?; elastic 2 0
isc; isc; isc
zlib; zlib( libpng)?; zlib
libpng; libpng; libpng
unlicense; unlicense; unlicense
wtfpl; wtfpl|do what the fuck you want to public license; wtfpl
python-2; python software foundation( license)?( version| ?v)? ?2( 0)?|psf( version| ?v)? ?2( 0)?; psf 2 0
php-3.01; php( license)?( version| ?v)? ?3 01; php 3 01
ruby; ruby; ruby
postgresql; postgresql; postgresql
openssl; openssl; openssl
curl; curl; curl
ncsa; university of illinois ncsa( open source)?|ncsa( open source)?; ncsa
w3c; w3c( software)?( notice and)?; w3c
vim; vim; vim
eupl-1.1; european union public licen[cs]e( version| ?v)? ?1 1|eupl( version| ?v)? ?1 1; eupl 1 1
eupl-1.2; european union public licen[cs]e( version| ?v)? ?1 2|eupl( version| ?v)? ?1 2; eupl 1 2
cecill-2.1; cecill( version| ?v)? ?2 1; cecill 2 1
cecill-b; cecill b; cecill b
cecill-c; cecill c; cecill c
ofl-1.1; (sil )?open font license( version| ?v)? ?1 1|ofl( version| ?v)? ?1 1; ofl 1 1
upl-1; universal permissive license( version| ?v)? ?1( 0)?; upl 1 0
ms-pl; microsoft public license|ms pl; ms pl
ms-rl; microsoft reciprocal license|ms rl; ms rl
mulan-psl-2; mulan( permissive software)?( license)?( version| ?v)? ?2|mulan psl( version| ?v)? ?2; mulanpsl 2 0
odbl-1; open (data commons open )?database license( version| ?v)? ?1( 0)?|odbl( version| ?v)? ?1( 0)?; odbl 1 0
odc-by-1; open data commons attribution license( version| ?v)? ?1( 0)?|odc by; odc by 1 0
pddl-1; public domain dedication and license( version| ?v)? ?1( 0)?|pddl; pddl 1 0
cc0; cc0( 1 0)?|cc zero|creative commons zero; cc0 1 0
cc-by; cc by( [1-4] [05])?|creative commons attribution( [1-4] [05])?; cc by 4 0
cc-by-sa; cc by sa( [1-4] [05])?|creative commons attribution share ?alike( [1-4] [05])?; cc by sa 4 0
cc-by-nd; cc by nd( [1-4] [05])?|creative commons attribution no ?deriv(ative)?s?( works)?( [1-4] [05])?; cc by nd 4 0
cc-by-nc; cc by nc( [1-4] [05])?|creative commons attribution non ?commercial( [1-4] [05])?; cc by nc 4 0
cc-by-nc-sa; cc by nc sa( [1-4] [05])?|creative commons attribution non ?commercial share ?alike( [1-4] [05])?; cc by nc sa 4 0
cc-by-nc-nd; cc by nc nd( [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?( [1-4] [05])?; cc by nc nd 4 0
llama-2; llama 2 community; llama2
llama-3; llama 3( [1-3])? community; llama3
openrail; (creativeml |bigscience |bigcode )?open ?rail( m)?; openrail
gpl; gnu (gpl|general public licen[cs]e)|gpl; gpl
lgpl; (gnu )?(lgpl|(lesser|library) general public licen[cs]e); lgpl
agpl; (gnu )?(agpl|affero general public licen[cs]e); agpl
mpl; mpl|mozilla public licen[cs]e; mpl
apache; apache; apache
bsd; bsd; bsd
"""

#: label; sentences and phrases of the license's own text or of usual notices.
PHRASES = r"""
mit; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; the above copyright notice and this permission notice shall be included in all copies
mit; licensed (under|with) (the )?mit( licen[cs]e)?
isc; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
apache-2; licensed under the apache license version 2( 0)?( the license)?
apache-2; you may not use this file except in compliance with the license
bsd-2-clause; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause; neither the name of( the)? [^ ]+( [^ ]+){0,6} nor the names of its contributors
bsd-4-clause; all advertising materials mentioning features or use of this software must display
gpl-2; either version 2 of the license or (at your option )?any later version
gpl-3; either version 3 of the license or (at your option )?any later version
gpl; this program is free software you can redistribute it and or modify it
gpl; (released|distributed|licensed|available) under (the )?(terms of the )?(gnu )?(gpl|general public license)
lgpl; (released|distributed|licensed|available) under (the )?(terms of the )?(gnu )?(lgpl|lesser general public license)
agpl; (released|distributed|licensed|available) under (the )?(terms of the )?(gnu )?(agpl|affero general public license)
mpl-2; this source code form is subject to the terms of the mozilla public license
epl-2; this program and the accompanying materials are made available under the terms of the eclipse public license
bsl-1; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib; altered source versions must be plainly marked as such
unlicense; this is free and unencumbered software released into the public domain
cc-by; this work is licensed under (a|the) creative commons attribution( [1-4] [05])?( international)? license
cc; (this work is )?licensed under (a|the) creative commons
public-domain; (released|dedicated|placed) (in|into|to) the public domain
public-domain; this (work|file|text|code) is in the public domain
ofl-1.1; this font software is licensed under the sil open font license
proprietary; all rights reserved
proprietary; unauthorized (copying|use|reproduction|distribution)( or distribution)? of this
proprietary; proprietary and confidential
non-commercial; (for )?non ?commercial use only
no-warranty; without warranty of any kind
no-warranty; provided by the copyright holders and contributors as is
mit; the software is provided as is without warranty of any kind express or implied including but not limited to
mit; to use copy modify merge publish distribute sublicense and or sell copies of the software
mit; opensource org licenses mit( license)?( php| html)?
mit; (this|the) (project|package|library|module|code|software|crate|gem) is (available|released|licensed|distributed|free software) under the mit
x11; except as contained in this notice the name of [^ ]+( [^ ]+){0,6} shall not be used in advertising
0bsd; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
isc; in no event shall the author be liable for any special direct indirect or consequential damages
apache-2; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2; apache org licenses license 2 0( txt| html)?
apache-2; grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1; the end user documentation included with the redistribution if any must include the following acknowledg(e)?ment
bsd-2-clause; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause; redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause; may be used to endorse or promote products derived from this software without specific prior written permission
bsd; (use of this source code|this source code) is governed by a bsd style license
bsd; (released|distributed|licensed|available) under (the |a )?(terms of the )?bsd( style)? licen[cs]e
gpl-2; under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-2; gnu org licenses (old licenses )?gpl 2 0
gpl-3; under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-3; gnu org licenses gpl 3 0
gpl; you should have received a copy of the gnu general public license along with this program
gpl; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lgpl; you should have received a copy of the gnu (lesser|library) general public license
lgpl-2.1; under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3; under the terms of the gnu lesser general public license as published by the free software foundation either version 3
agpl-3; under the terms of the gnu affero general public license as published by the free software foundation either version 3
agpl; you should have received a copy of the gnu affero general public license
gfdl; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2; if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1; the contents of this file are subject to the mozilla public license version 1 1
npl-1.1; the contents of this file are subject to the netscape public license
epl-1; eclipse org legal epl v10( html)?
epl-2; eclipse org legal epl 2 0
cddl; the contents of this file are subject to the terms of the common development and distribution license
bsl-1; distributed under the boost software license version 1 0
bsl-1; boost org license 1 0( txt)?
busl-1.1; use of this software is governed by the business source license
elastic-2; you may not provide the software to third parties as a hosted or managed service
sspl-1; licensed under the server side public license
zlib; this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib; the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense; anyone is free to copy modify publish use compile sell or distribute this software
wtfpl; everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
wtfpl; you just do what the fuck you want to
beerware; if we meet some day and you think this stuff is worth it you can buy me a beer in return
cc0; to the extent possible under law [^ ]+( [^ ]+){0,8} (has|have) waived all copyright and related or neighboring rights
cc0; creativecommons org publicdomain zero 1 0
public-domain; creativecommons org publicdomain mark 1 0
cc-by; creativecommons org licenses by [1-4] [05]
cc-by-sa; creativecommons org licenses by sa [1-4] [05]
cc-by-nd; creativecommons org licenses by nd [1-4] [05]
cc-by-nc; creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa; creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd; creativecommons org licenses by nc nd [1-4] [05]
cc-by-sa; text is available under the creative commons attribution share ?alike license
public-domain; no rights reserved
public-domain; (author|authors) (disclaims?|waives?) (all )?copyright
odbl-1; opendatacommons org licenses odbl
odbl-1; (c )?openstreetmap contributors
ofl-1.1; scripts sil org ofl
openssl; this product includes software developed by the openssl project
postgresql; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
python-2; psf is making python available to licensee on an as is basis
php-3.01; this source file is subject to version 3 01 of the php license
ruby; you may redistribute (this library|it) and or modify it under the same terms as ruby
perl; (free software you can redistribute it and or modify it|licensed) under the same terms as perl( itself)?
vim; charityware you can use and copy it as much as you like
json; the software shall be used for good not evil
commons-clause; the license does not include the right to sell the software
commons-clause; commons clause license condition
polyform; polyform (noncommercial|small business|shield|strict) license
llama-2; llama 2 is licensed under the llama 2 community license
llama-3; (llama 3( [1-3])? is licensed under the|built with) (meta )?llama 3( [1-3])?( community license)?
openrail; use based restrictions (set forth|as referenced) in (paragraph|attachment|the)
gov; this is a work of the (u s|united states) government
crown; contains public sector information licensed under the open government licence
proprietary; no part of this (publication|work|book|document|material) may be reproduced( stored| distributed| or transmitted)?
proprietary; may not be (copied|reproduced|redistributed|distributed) without (the )?(prior |express )?(written )?(permission|consent)
proprietary; (reproduced|reprinted|used) with (the )?permission (of|from)
proprietary; this (software|document|material) (contains|is) (the )?(confidential|proprietary)( and proprietary)? (information|property)
proprietary; trade secrets? of
evaluation; for (evaluation|trial|demonstration) (purposes )?only
academic; for (research|academic|educational|teaching)( and (research|educational|academic))? (use|purposes) only
no-derivatives; no derivative works
no-ai; may not be used (to train|for training|in the training of)
no-warranty; in no event shall the (authors|copyright (holders?|owner)|regents)( or( copyright holders| contributors)?)? be liable
no-warranty; use (it )?at your own risk
copyright; copyright( c)? (19|20)[0-9]{2}( (19|20)[0-9]{2})*
gpl-2; gpl ?v ?2( 0)?
gpl-3; gpl ?v ?3( 0)?
lgpl-2.1; lgpl ?v ?2 1
lgpl-3; lgpl ?v ?3( 0)?
agpl-3; agpl ?v ?3( 0)?
"""
#: How a name stands in a text: pattern around it, priority, confidence.
FRAMES = (
    ("named", r"{name}(?: software| public)? licen[cs]e", 60, 0.9),
    ("under", r"(?:under|subject to|terms of|licensed) (?:the |a |either (?:of )?(?:the )?)?(?:terms of the )?(?:{name})", 80, 0.95),
    ("bracket", r"licen[cs]e (?:is |type |name |id )?(?:the )?(?:{name})", 50, 0.8),
    ("adjective", r"(?:{name}) licen[cs]ed", 75, 0.9),
    ("either", r"(?:{first})(?:the )?(?:{name})", 65, 0.8),
)
#: Names before an "or" or "and" behind which another name counts.
FIRST = ("mit", "apache 2 0", "apache 2", "apache", "bsd", "bsd 3 clause", "bsd 2 clause", "isc", "gpl", "gpl 2 0", "gpl 3 0", "gplv2", "gplv3", "lgpl", "mpl 2 0", "mpl", "cc0", "unlicense", "zlib")
SPDX = (r"spdx license identifier {name}", 100, 1.0)


def _gates(parsed) -> list[frozenset[bytes]]:
    """Sets of strings of a parsed expression: a match has one of each set. Sets with strings of one byte are left out."""
    out, run = [], bytearray()
    for kind, value in [*parsed, (None, None)]:
        if kind is C.LITERAL:
            run.append(value)
            continue
        if len(run) > 1:
            out.append(frozenset([bytes(run)]))
        run = bytearray()
        if kind is C.SUBPATTERN:
            out += _gates(value[3])
        elif kind is C.MAX_REPEAT and value[0] > 0:
            out += _gates(value[2])
        elif kind is C.BRANCH:
            each = [max(_gates(x), key=lambda g: min(map(len, g)), default=None) for x in value[1]]
            if None not in each:
                out.append(frozenset().union(*each))
    return out


def gates(pattern: bytes) -> tuple[frozenset[bytes], ...]:
    """The gates of an expression, those that many rules share first."""
    own = list(dict.fromkeys(_gates(_parser.parse(pattern))))
    shared = [frozenset([s]) for s in STEMS if any(all(s in x for x in g) for g in own)]
    return tuple(dict.fromkeys(shared + own))


@lru_cache(maxsize=1)
def rules() -> list[tuple[str, int, float, tuple[frozenset[bytes], ...], re.Pattern]]:
    """(label, priority, confidence, gates, expression), in order."""
    out = []

    def add(label: str, priority: int, confidence: float, pattern: str) -> None:
        out.append((label, priority, confidence, gates(pattern.encode()), re.compile(b"(?<![^ ])(?:" + pattern.encode() + b")(?![^ ])")))

    for line in filter(None, PHRASES.splitlines()):
        label, pattern = line.split("; ")
        add(label, 70 if "license" in pattern or "licensed" in pattern else 40, 0.9 if label not in ("copyright", "proprietary", "no-warranty") else 0.5, pattern)
    for line in filter(None, NAMES.splitlines()):
        label, name, identifier = line.split("; ")
        add(label, SPDX[1], SPDX[2], SPDX[0].format(name=identifier))
        for _, frame, priority, confidence in FRAMES:
            add(label, priority, confidence, frame.format(name=f"(?:{name})", first="|".join(f"(?<= {x} {link} )" for x in FIRST for link in ("or", "and"))))
        if label.startswith("cc"):
            add(label, 55, 0.85, name)
    return out


def settle(finds: list[tuple[int, int, int, int, str, float]]) -> list[tuple]:
    """Of (start, end, priority, rule, label, confidence): none inside a longer one, none that overlaps a better one."""
    finds.sort(key=lambda f: (f[0], -f[1], -f[2], f[3]))
    outer, reach = [], -1
    for f in finds:
        if f[1] > reach:  # starts are in order, so that a find within the reach of an earlier one lies inside it
            outer.append(f)
            reach = f[1]
    out: list[tuple] = []
    for f in sorted(outer, key=lambda f: (-f[2], f[0] - f[1], f[0], f[3])):
        at = bisect_left(out, f[:1])
        if (at == 0 or out[at - 1][1] <= f[0]) and (at == len(out) or out[at][0] >= f[1]):
            insort(out, f)
    return out


_PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def scan(raw: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """(words, (first word, label) of each place of a base phrase, (start, end, label, confidence) of each find)."""
    parts = raw.translate(_PLAIN).split(b" ")
    parts = list(filter(None, parts))
    text = b" ".join(parts)
    base = []
    for phrase, label in BASE:
        at, word, counted = text.find(phrase), 0, 0
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or text[at - 1] == 32) and (end == len(text) or text[end] == 32):
                word, counted = word + text.count(b" ", counted, at), at
                base.append((word, label))
            at = text.find(phrase, at + 1)
    finds = []
    there: dict[frozenset[bytes], bool] = {}
    for k, (label, priority, confidence, needed, pattern) in enumerate(rules()):
        for gate in needed:
            if gate not in there:
                there[gate] = any(x in text for x in gate)
            if not there[gate]:
                break
        else:
            finds += [(m.start(), m.end(), priority, k, label, confidence) for m in pattern.finditer(text)]
    finds = [(s, e, label, c) for s, e, _, _, label, c in settle(finds)]
    return len(parts), base, finds


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def summary_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            n, base, finds = scan(raw.as_py() or b"")
            starts, own = [b[0] for b in base], {b[1] for b in base}
            rows.append((doc_id, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {f[2] for f in finds})), 1.0 if base else max((f[3] for f in finds), default=0.0)))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), OUT.types, strict=True)] if rows else [pa.array([], t) for t in OUT.types], schema=OUT)


def find_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "end", "label", "confidence"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
    for batch in batches:
        rows = [(doc_id, *f) for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True) for f in scan(raw.as_py() or b"")[2]]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def summaries(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: words, base phrases, all labels, and the highest confidence of a find.

    A null text is empty, has no words and scores 0. Rows repeated and null ids are scanned each. Columns besides
    ``doc_id`` and ``text`` are not read. Nothing is shuffled.
    """
    return _input(docs).mapInArrow(summary_task, DDL)


def detections(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, confidence) of each find that stays; places are bytes of the words joined by a space."""
    return _input(docs).mapInArrow(find_task, "doc_id long, start long, end long, label string, confidence double")
