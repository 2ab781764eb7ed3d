"""Operator 3: license detection by ordered signature rules.

Rules are expressions over lower-cased text (A-Z only): about 200 written by hand (sentences of license texts, headers,
notices, addresses, and places where a license is named but not granted), and tags and names with versions that are
written out from a table of license families.  Each has a keyword that must occur before the expression is tried (words,
whatever separates them), a priority, a weight and a label.  Detections that overlap are resolved in order of priority,
then length, then start, then label: one that lies within an accepted one is suppressed.  Base phrases are words that
stand consecutively; they are counted at all their places and never suppressed.

The score is 0 with no label, else 1 - prod(1 - weight) over the kept detections' rules; base places alone give 0.8.
Two detections of equal priority and place count both, so that the score depends on no order.

Defined results: null text counts as empty; empty text has no detection (nulls for first_word and last_word,
'' for labels); a text of any length is read whole; repeated rows give repeated rows; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import bytes_of, frugal, id_text, slices

#: Words are runs of what is not an ASCII control, blank or punctuation mark; lower-casing is that of A-Z.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = bytes(b for b in range(128) if not re.match(WORD, bytes([b])))
#: Base phrases and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: License families: label, names in texts, SPDX stem, versions ('' where there is none).
FAMILIES = [
    ("gpl", ("gnu general public license", "gnu gpl", "gplv"), "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl"), "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl"), "agpl", ("1.0", "3.0")),
    ("gfdl", ("gnu free documentation license",), "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", ("apache license", "apache software license"), "apache", ("1.0", "1.1", "2.0")),
    ("mit", ("mit license", "expat license", "x11 license"), "mit", ("",)),
    ("bsd-2-clause", ("simplified bsd license", "two clause bsd license", "2 clause bsd license", "freebsd license"), "bsd-2-clause", ("",)),
    ("bsd-3-clause", ("new bsd license", "revised bsd license", "modified bsd license", "3 clause bsd license"), "bsd-3-clause", ("",)),
    ("bsd-4-clause", ("original bsd license", "4 clause bsd license"), "bsd-4-clause", ("",)),
    ("isc", ("isc license",), "isc", ("",)),
    ("zlib", ("zlib license", "zlib libpng license"), "zlib", ("",)),
    ("mpl", ("mozilla public license",), "mpl", ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public license",), "epl", ("1.0", "2.0")),
    ("cpl", ("common public license",), "cpl", ("1.0",)),
    ("cddl", ("common development and distribution license",), "cddl", ("1.0", "1.1")),
    ("eupl", ("european union public license", "european union public licence"), "eupl", ("1.0", "1.1", "1.2")),
    ("osl", ("open software license",), "osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic free license",), "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic license", "perl artistic license"), "artistic", ("1.0", "2.0")),
    ("bsl", ("boost software license",), "bsl", ("1.0",)),
    ("busl", ("business source license",), "busl", ("1.1",)),
    ("sspl", ("server side public license",), "sspl", ("1.0",)),
    ("cecill", ("cecill free software license", "licence cecill"), "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("ofl", ("sil open font license", "open font license"), "ofl", ("1.0", "1.1")),
    ("lppl", ("latex project public license",), "lppl", ("1.0", "1.1", "1.2", "1.3a", "1.3c")),
    ("python", ("python software foundation license", "psf license"), "python", ("2.0",)),
    ("php", ("php license",), "php", ("3.0", "3.01")),
    ("ms-pl", ("microsoft public license",), "ms-pl", ("",)),
    ("ms-rl", ("microsoft reciprocal license",), "ms-rl", ("",)),
    ("ncsa", ("university of illinois ncsa open source license", "ncsa license"), "ncsa", ("",)),
    ("unlicense", ("the unlicense",), "unlicense", ("",)),
    ("wtfpl", ("do what the fuck you want to public license",), "wtfpl", ("",)),
    ("odbl", ("open database license", "open data commons open database license"), "odbl", ("1.0",)),
    ("odc-by", ("open data commons attribution license",), "odc-by", ("1.0",)),
    ("pddl", ("public domain dedication and license",), "pddl", ("1.0",)),
    ("llama", ("llama 2 community license", "llama 3 community license", "llama community license"), "llama", ("",)),
    ("openrail", ("open rail license", "responsible ai license", "creativeml open rail m"), "openrail", ("",)),
]
#: Creative Commons: elements, long names, versions.
CC_KINDS = {
    "cc-by": "attribution",
    "cc-by-sa": "attribution sharealike",
    "cc-by-nd": "attribution noderivatives",
    "cc-by-nc": "attribution noncommercial",
    "cc-by-nc-sa": "attribution noncommercial sharealike",
    "cc-by-nc-nd": "attribution noncommercial noderivatives",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Signatures written by hand: label, keyword, priority, weight, words.  `*` stands for up to four words of any kind.
#: Sentences of license texts, headers and notices that speak of a license without its name, or with a name of their own.
SIGNATURES = """
mit | permission is hereby granted | 60 | 0.9 | permission is hereby granted free of charge to any person obtaining a copy
mit | without restriction | 58 | 0.6 | to deal in the software without restriction including without limitation the rights
mit | substantial portions | 59 | 0.8 | shall be included in all copies or substantial portions of the software
mit | merge publish distribute | 59 | 0.8 | use copy modify merge publish distribute sublicense and or sell copies
mit | holders be liable | 57 | 0.6 | in no event shall the authors or copyright holders be liable for any claim
mit | mit licensed | 66 | 0.8 | mit licensed
mit | mit style | 64 | 0.7 | mit style license
mit | mit license | 72 | 0.9 | released under the mit license
mit | mit license | 72 | 0.9 | licensed under the mit license
mit | mit license | 72 | 0.9 | distributed under the mit license
mit-0 | no attribution | 73 | 0.9 | mit no attribution
x11 | x consortium | 61 | 0.8 | except as contained in this notice the name of the x consortium
isc | permission to use | 60 | 0.8 | permission to use copy modify and or distribute this software for any purpose
isc | with or without fee | 59 | 0.7 | for any purpose with or without fee is hereby granted
0bsd | zero clause | 73 | 0.9 | zero clause bsd
hpnd | appear in supporting documentation | 58 | 0.7 | this permission notice appear in supporting documentation
bsd | redistribution and use | 60 | 0.9 | redistribution and use in source and binary forms with or without modification
bsd | redistributions of source code | 59 | 0.8 | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form | 59 | 0.8 | redistributions in binary form must reproduce the above copyright notice
bsd | bsd style | 64 | 0.7 | bsd style license
bsd | bsd license | 68 | 0.7 | bsd license
bsd | bsd licensed | 66 | 0.7 | bsd licensed
bsd-3-clause | neither the name | 61 | 0.9 | neither the name of
bsd-3-clause | endorse or promote | 60 | 0.8 | to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising materials | 62 | 0.9 | all advertising materials mentioning features or use of this software
gpl | free software foundation | 55 | 0.7 | published by the free software foundation
gpl | redistribute it and or modify | 56 | 0.8 | you can redistribute it and or modify it under the terms of the gnu
gpl | at your option | 54 | 0.5 | at your option any later version
gpl | merchantability or fitness | 53 | 0.4 | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | you should have received | 56 | 0.7 | you should have received a copy of the gnu general public license
gpl | see the gnu | 55 | 0.6 | see the gnu general public license for more details
gpl | freedom to share | 57 | 0.7 | intended to guarantee your freedom to share and change
gpl | copyleft | 45 | 0.4 | copyleft
gpl | covered work | 56 | 0.7 | to propagate a covered work
gpl | corresponding source | 56 | 0.7 | the corresponding source for a work in source code form
gpl | viral | 41 | 0.3 | viral license
gpl | gpl compatible | 58 | 0.5 | gpl compatible
gpl | gpled | 58 | 0.6 | gpled
lgpl | gnu lesser | 63 | 0.8 | under the terms of the gnu lesser general public license
lgpl | work that uses the library | 62 | 0.8 | work that uses the library
lgpl | lgpl | 64 | 0.7 | lgpl
agpl | remotely through a computer network | 63 | 0.9 | users interacting with it remotely through a computer network
agpl | agpl | 64 | 0.7 | agpl
gfdl | invariant sections | 62 | 0.9 | with no invariant sections
gfdl | cover texts | 62 | 0.8 | no front cover texts and no back cover texts
gcc-exception | runtime library exception | 74 | 0.9 | gcc runtime library exception
classpath-exception | classpath | 74 | 0.9 | classpath exception
linking-exception | linking exception | 66 | 0.7 | linking exception
font-exception | font exception | 66 | 0.7 | font exception
apache | you may not use this file | 62 | 0.9 | you may not use this file except in compliance with the license
apache | unless required by applicable law | 58 | 0.7 | unless required by applicable law or agreed to in writing
apache | limitations under the license | 58 | 0.6 | see the license for the specific language governing permissions and limitations under the license
apache | contributor license agreements | 58 | 0.6 | under one or more contributor license agreements
apache | apache licensed | 66 | 0.8 | apache licensed
apache | apache software foundation | 55 | 0.5 | licensed to the apache software foundation
apache-2.0 | apache2 | 75 | 0.9 | apache2
apache-2.0 | asl2 | 75 | 0.8 | asl2
zlib | altered source versions | 60 | 0.9 | altered source versions must be plainly marked as such
zlib | origin of this software | 60 | 0.9 | the origin of this software must not be misrepresented
zlib | as is without | 50 | 0.4 | provided as is without any express or implied warranty
libpng | libpng | 64 | 0.8 | libpng license
mpl | source code form is subject | 62 | 0.9 | this source code form is subject to the terms of the mozilla public license
mpl | incompatible with secondary licenses | 62 | 0.8 | incompatible with secondary licenses
mpl | mpl 2 | 66 | 0.8 | mpl 2 0
mpl | covered software | 55 | 0.5 | distribution of covered software
epl | accompanying materials are made available | 62 | 0.9 | accompanying materials are made available under the terms of the eclipse public license
epl | eclipse distribution | 68 | 0.8 | eclipse distribution license
cddl | cddl | 64 | 0.7 | cddl
eupl | eupl | 64 | 0.8 | licensed under the eupl
artistic | standard version | 58 | 0.7 | the standard version of the package
artistic | same terms as perl | 66 | 0.8 | under the same terms as perl itself
bsl | machine executable object code | 62 | 0.8 | solely in the form of machine executable object code generated by a source language processor
busl | change date | 58 | 0.6 | change date
busl | additional use grant | 60 | 0.9 | additional use grant
sspl | functionality of the program | 60 | 0.7 | make the functionality of the program * available to third parties as a service
elastic | elastic license | 72 | 0.9 | elastic license
commons-clause | commons clause | 72 | 0.9 | commons clause
confluent | confluent community license | 72 | 0.9 | confluent community license
redis | redis source available | 72 | 0.9 | redis source available license
polyform | polyform | 72 | 0.8 | polyform * license
cecill | cecill | 64 | 0.8 | under the cecill license
ofl | reserved font name | 62 | 0.9 | reserved font name
ofl | sil open font | 66 | 0.9 | sil open font license
lppl | maintenance status | 60 | 0.8 | lppl maintenance status
python | python software foundation | 62 | 0.7 | python software foundation license agreement
php | this product includes php | 62 | 0.8 | this product includes php software
ruby | ruby license | 66 | 0.8 | ruby license
openssl | openssl toolkit | 62 | 0.9 | for use in the openssl toolkit
openssl | openssl license | 68 | 0.9 | openssl license
curl | curl license | 66 | 0.8 | curl license
vim | vim license | 66 | 0.8 | vim license
w3c | w3c software notice | 66 | 0.9 | w3c software notice and license
unicode | unicode license | 66 | 0.8 | unicode license
icu | icu license | 66 | 0.8 | icu license
postgresql | postgresql license | 66 | 0.9 | postgresql license
ijg | independent jpeg group | 62 | 0.8 | independent jpeg group
bzip2 | bzip2 license | 66 | 0.8 | bzip2 license
beerware | beer ware | 64 | 0.9 | beer ware license
beerware | buy me a beer | 60 | 0.7 | you can buy me a beer in return
wtfpl | wtfpl | 66 | 0.9 | wtfpl
unlicense | free and unencumbered | 62 | 0.9 | this is free and unencumbered software released into the public domain
unlicense | unlicense org | 66 | 0.9 | unlicense org
cc0-1.0 | no rights reserved | 58 | 0.7 | no rights reserved
cc0-1.0 | creative commons | 69 | 0.9 | creative commons zero
cc0-1.0 | waived all copyright | 60 | 0.9 | waived all copyright and related or neighboring rights
public-domain | public domain | 50 | 0.7 | released into the public domain
public-domain | public domain | 50 | 0.7 | dedicated to the public domain
public-domain | public domain | 50 | 0.7 | placed in the public domain
public-domain | public domain | 45 | 0.5 | in the public domain
public-domain | disclaims copyright | 52 | 0.7 | the author disclaims copyright to this source code
public-domain | united states government | 52 | 0.6 | work of the united states government
cc | some rights reserved | 52 | 0.6 | some rights reserved
cc | creative commons | 55 | 0.6 | creative commons license
cc | creative commons | 55 | 0.6 | creative commons licence
cc | creative commons | 57 | 0.7 | licensed under a creative commons
cc-by | appropriate credit | 52 | 0.5 | you must give appropriate credit
cc-by-sa | share alike | 53 | 0.6 | attribution share alike
cc-by-nc | non commercial | 53 | 0.6 | attribution non commercial
cc-by-nd | no derivatives | 53 | 0.6 | attribution no derivatives
cc-sampling | sampling plus | 60 | 0.8 | creative commons sampling plus
odbl | open database | 62 | 0.8 | made available under the open database license
odc-by | odc by | 62 | 0.8 | odc by
pddl | pddl | 62 | 0.8 | pddl
cdla | community data license | 68 | 0.9 | community data license agreement
ogl | open government | 68 | 0.9 | open government licence
etalab | licence ouverte | 68 | 0.8 | licence ouverte
dl-de | datenlizenz deutschland | 68 | 0.9 | datenlizenz deutschland
llama | llama materials | 62 | 0.8 | llama materials
llama | built with llama | 58 | 0.6 | built with llama
gemma | gemma terms of use | 66 | 0.9 | gemma terms of use
openrail | use based restrictions | 62 | 0.8 | use based restrictions
bigscience | bigscience | 64 | 0.8 | bigscience rail license
bigcode | bigcode openrail | 68 | 0.9 | bigcode openrail m
falcon | falcon llm | 62 | 0.8 | falcon llm license
research-only | research purposes only | 56 | 0.7 | for research purposes only
research-only | academic use only | 56 | 0.7 | for academic use only
non-commercial | commercial use only | 56 | 0.7 | for non commercial use only
non-commercial | noncommercial use only | 56 | 0.7 | for noncommercial use only
non-commercial | not for commercial use | 56 | 0.7 | not for commercial use
non-commercial | personal use only | 55 | 0.6 | for personal use only
evaluation-only | evaluation purposes | 56 | 0.6 | for evaluation purposes only
shareware | shareware | 44 | 0.4 | shareware
freeware | freeware | 44 | 0.4 | freeware
proprietary | all rights reserved | 40 | 0.4 | all rights reserved
proprietary | proprietary and confidential | 41 | 0.8 | proprietary and confidential
proprietary | confidential and proprietary | 41 | 0.8 | confidential and proprietary
proprietary | unauthorized copying | 41 | 0.8 | unauthorized copying of this file
proprietary | trade secrets | 41 | 0.6 | contains trade secrets of
proprietary | may not be reproduced | 41 | 0.6 | may not be reproduced or transmitted in any form
proprietary | prior written permission | 39 | 0.4 | without the prior written permission of the publisher
proprietary | end user license agreement | 42 | 0.7 | end user license agreement
proprietary | reverse engineer | 42 | 0.5 | you may not reverse engineer decompile or disassemble
proprietary | strictly prohibited | 41 | 0.5 | reproduction is strictly prohibited
proprietary | commercial license | 42 | 0.5 | commercial license
proprietary | subscription agreement | 41 | 0.4 | subscription agreement
dual | dual licensed | 52 | 0.5 | dual licensed under
dual | tri license | 52 | 0.5 | mozilla tri license
open-source | open source license | 43 | 0.4 | open source license
open-source | osi approved | 48 | 0.5 | osi approved
open-source | license txt | 43 | 0.4 | see license txt
open-source | license file | 43 | 0.4 | see the license file
open-source | file for licensing | 43 | 0.4 | see * file for licensing information
"""
#: Words in which the name of a license stands but grants nothing; what lies within such a place is no detection.
NEGATIVES = """
license plate | license plate number
license plate | license plate
license | driver s license
license | drivers license
license | driving license
license | software license manager
license | license key
license | license server
licensed | not licensed under the * license
license | not under the * license
license | instead of the * license
license | incompatible with the * license
license | unlike the * license
licensed | licensed practical nurse
licensed | licensed physician
license | marriage license
license | poetic license
license | artistic license of the director
license | fishing license
license | liquor license
"""
#: Addresses of license texts: label, keyword, priority, weight, expression (after lower-casing).
ADDRESSES = r"""
gpl | gnu.org/licenses | 88 | 0.9 | gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl
lgpl | gnu.org/licenses | 89 | 0.9 | gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl
agpl | gnu.org/licenses | 89 | 0.9 | gnu\.org/licenses/agpl
gfdl | gnu.org/licenses | 89 | 0.9 | gnu\.org/(?:licenses|copyleft)/fdl
gpl | gnu.org/licenses | 70 | 0.6 | gnu\.org/licenses/?(?![a-z/])
apache-2.0 | apache.org/licenses | 90 | 1.0 | apache\.org/licenses/license-2\.0
apache | apache.org/licenses | 80 | 0.8 | apache\.org/licenses/?(?![a-z/])
mit | opensource.org/licenses | 88 | 0.9 | opensource\.org/licenses?/mit(?![a-z0-9-])
bsd-2-clause | opensource.org/licenses | 88 | 0.9 | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | opensource.org/licenses | 88 | 0.9 | opensource\.org/licenses?/bsd-3-clause
bsd | opensource.org/licenses | 80 | 0.8 | opensource\.org/licenses?/bsd-license
isc | opensource.org/licenses | 88 | 0.9 | opensource\.org/licenses?/isc
zlib | opensource.org/licenses | 88 | 0.9 | opensource\.org/licenses?/zlib
artistic-2.0 | opensource.org/licenses | 88 | 0.9 | opensource\.org/licenses?/artistic-license-2\.0
open-source | opensource.org/licenses | 60 | 0.4 | opensource\.org/licenses?/?(?![a-z0-9])
mpl-2.0 | mozilla.org | 88 | 0.9 | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl | mozilla.org | 80 | 0.8 | mozilla\.org/(?:en-us/)?mpl/?(?![0-9])
epl-1.0 | eclipse.org | 88 | 0.9 | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse.org | 88 | 0.9 | eclipse\.org/legal/epl-(?:2\.0|v20)
bsl-1.0 | boost.org | 88 | 0.9 | boost\.org/license_1_0\.txt
unlicense | unlicense.org | 88 | 0.9 | unlicense\.org
ofl | scripts.sil.org | 88 | 0.9 | scripts\.sil\.org/ofl
cc | creativecommons.org | 60 | 0.6 | creativecommons\.org/licenses/?(?![a-z])
public-domain | creativecommons.org | 85 | 0.8 | creativecommons\.org/publicdomain/mark/1\.0
odbl | opendatacommons.org | 88 | 0.9 | opendatacommons\.org/licenses/odbl
odc-by | opendatacommons.org | 88 | 0.9 | opendatacommons\.org/licenses/by
pddl | opendatacommons.org | 88 | 0.9 | opendatacommons\.org/licenses/pddl
ogl | nationalarchives.gov.uk | 88 | 0.9 | nationalarchives\.gov\.uk/doc/open-government-licence
cdla | cdla.dev | 88 | 0.9 | cdla\.dev/(?:permissive|sharing)
python | docs.python.org | 80 | 0.8 | docs\.python\.org/(?:[23]/)?license
php | php.net/license | 80 | 0.8 | php\.net/license
wtfpl | wtfpl.net | 88 | 0.9 | wtfpl\.net
"""


def _rows(table: str, n: int) -> list[list[str]]:
    rows = [[c.strip() for c in line.split(" | ")] for line in table.strip().splitlines()]
    if any(len(r) != n for r in rows):
        raise ValueError("a row of a table of rules has another number of columns")
    return rows


class Rule(NamedTuple):
    label: str
    keyword: bytes
    priority: int
    weight: float
    pattern: re.Pattern


def _words(text: str, open_end: bool = False) -> bytes:
    """An expression for words that stand consecutively, whatever separates them."""
    few = rb"(?:" + WORD + rb"+" + GAP + rb"){0,4}?"
    body = b""
    for w in re.findall(r"[a-z0-9]+|\*", text):
        body += few if w == "*" else re.escape(w.encode()) + GAP
    body = body.removesuffix(GAP)
    return rb"(?<!" + WORD + rb")" + body + (b"" if open_end else rb"(?!" + WORD + rb")")


def signature_rules() -> list[Rule]:
    """All rules in order of priority: SPDX tags, names with versions, URLs, names, clauses."""
    rules: list[Rule] = []

    def add(label: str, keyword: str, priority: int, weight: float, pattern: bytes) -> None:
        rules.append(Rule(label, keyword.encode(), priority, weight, re.compile(pattern)))

    def version(v: str) -> bytes:
        major, _, minor = v.partition(".")
        return rb"(?:" + GAP + rb"v(?:ersion)?)?" + rb"(?:" + GAP + rb")?(?:v)?" + re.escape(major.encode()) + (rb"(?:\." + re.escape(minor.encode()) + rb")" + (rb"?" if minor == "0" else b"")) + rb"(?![0-9]|\.[0-9])"

    for label, names, stem, versions in FAMILIES:
        for v in versions:
            tag = f"{stem}-{v}" if v else stem
            add(f"{label}-{v}" if v else label, "spdx", 100, 1.0, rb"spdx-license-identifier:\s*" + re.escape(tag.encode()) + rb"(?:-only|-or-later|\+)?(?![a-z0-9.-])")
            if v:
                for name in names:
                    add(f"{label}-{v}", name.split()[-1] if name != "gplv" else "gplv", 80, 0.95, _words(name, open_end=True) + version(v))
        for name in names:
            if name != "gplv":
                add(label, name.split()[0], 70, 0.8, _words(name))
    for label, name in CC_KINDS.items():
        path = label.removeprefix("cc-").encode()
        for v in CC_VERSIONS:
            add(f"{label}-{v}", "spdx", 100, 1.0, rb"spdx-license-identifier:\s*" + label.encode() + b"-" + re.escape(v.encode()) + rb"(?![a-z0-9.-])")
            add(f"{label}-{v}", "creativecommons.org", 90, 1.0, rb"creativecommons\.org/licenses/" + path + b"/" + re.escape(v.encode()) + rb"(?![0-9])")
            add(f"{label}-{v}", "cc", 80, 0.95, _words(label, open_end=True) + rb"[\s-]+" + re.escape(v.encode()) + rb"(?![0-9])")
            add(f"{label}-{v}", "creative commons", 80, 0.95, _words(f"creative commons {name}", open_end=True) + rb"(?:" + GAP + rb"(?:international|unported|generic|license))*" + version(v))
        add(label, "creative commons", 70, 0.8, _words(f"creative commons {name}"))
        add(label, "cc", 68, 0.8, _words(label))
    add("cc0-1.0", "cc0", 85, 1.0, rb"(?<!" + WORD + rb")cc0(?:[\s-]+1\.0)?(?!" + WORD + rb")")
    add("cc0-1.0", "creativecommons.org", 90, 1.0, rb"creativecommons\.org/publicdomain/zero/1\.0")
    for label, keyword, priority, weight, text in _rows(SIGNATURES, 5):
        add(label, keyword, int(priority), float(weight), _words(text))
    for label, keyword, priority, weight, pattern in _rows(ADDRESSES, 5):
        add(label, keyword, int(priority), float(weight), pattern.encode())
    for keyword, text in _rows(NEGATIVES, 2):
        add("", keyword, 110, 0.0, _words(text))
    return sorted(rules, key=lambda r: -r.priority)  # stable: rules of one priority keep their order


class LicenseScanner:
    def __init__(self, rules: list[Rule] | None = None):
        groups: dict[bytes, list[Rule]] = {}
        for rule in signature_rules() if rules is None else rules:
            groups.setdefault(rule.keyword, []).append(rule)
        self.groups = groups
        self.base = [(p.encode().split(), p.split()[0].encode(), label) for p, label in BASE.items()]
        self.base_any = [(p.split()[-1].encode() if p != "cc by" else b"cc", re.compile(_words(p))) for p in BASE]
        self.blank = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))

    def detections(self, low: bytes) -> list[tuple[int, int, Rule]]:
        """Kept detections of a lower-cased text, as byte spans, in order."""
        found = []
        # keywords of several words are looked up where single blanks separate words, as expressions allow any separator
        spaced = b" ".join(low.translate(self.blank).split())
        for keyword, rules in self.groups.items():
            if keyword in (spaced if b" " in keyword else low):
                found += [(m.start(), m.end(), rule) for rule in rules for m in rule.pattern.finditer(low)]
        if not found:
            return []
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        kept: list[tuple[int, int, Rule]] = []
        starts: list[int] = []
        reach: list[int] = []
        for start, end, rule in found:
            i = bisect_right(starts, start)
            if i and reach[i - 1] >= end:  # lies within one that was accepted before
                continue
            insort(kept, (start, end, rule), key=lambda x: x[:2])
            i = bisect_right(starts, start)
            starts.insert(i, start)
            reach.insert(i, max(end, reach[i - 1] if i else 0))
            while i + 1 < len(reach) and reach[i + 1] < reach[i]:
                i += 1
                reach[i] = reach[i - 1]
        return kept

    def base_places(self, low: bytes) -> list[tuple[int, str]]:
        """Word index and label of each place of each base phrase."""
        if not any(key in low and p.search(low) for key, p in self.base_any):
            return []
        words = low.translate(self.blank).split()
        out = []
        for phrase, first, label in self.base:
            n, at = len(phrase), -1
            while True:
                try:
                    at = words.index(first, at + 1)
                except ValueError:
                    break
                if words[at : at + n] == phrase:
                    out.append((at, label))
        return out

    def scan(self, text: bytes | None) -> dict:
        low = (text or b"").lower()  # of bytes: A-Z only
        places, found = self.base_places(low), self.detections(low)
        found = [d for d in found if d[2].label]  # what grants nothing has done its work
        labels = {label for _, label in places} | {rule.label for _, _, rule in found}
        miss = 1.0
        for _, _, rule in found:
            miss *= 1.0 - rule.weight
        if places and not found:
            miss = 0.2
        at = [i for i, _ in places]
        return {
            "n_words": len(low.translate(self.blank).split()),
            "n_base": len(places),
            "first_word": min(at, default=None),
            "last_word": max(at, default=None),
            "base_labels": ",".join(sorted({label for _, label in places})),
            "labels": ",".join(sorted(labels)),
            "score": round(1.0 - miss, 6) if labels else 0.0,
            "n_detections": len(found),
            "detections": ",".join(f"{rule.label}:{s}:{e}" for s, e, rule in found),
        }


FIELDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64()), ("detections", pa.string())])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, base places, labels, score, and the kept detections as label:start:end (bytes of the text's UTF-8)."""

    @frugal
    def scan(batches):
        scanner = LicenseScanner()
        for batch in batches:
            for part in slices(batch):
                rows = [{"doc_id": i} | scanner.scan(t) for i, t in zip(part.column("doc_id").to_pylist(), bytes_of(part))]
                yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)

    return id_text(df, id_col, text_col).mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long, detections string")
