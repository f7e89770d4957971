"""License scan: ordered signature rules behind a keyword gate, with containment suppression.

Everything runs as built-in DataFrame functions. A gate of keywords decides which texts are looked at
closely; those are reduced to words separated by single spaces, each rule is
tried only where one of its own keywords occurs, and detections contained in one of higher priority (or in a
longer one of equal priority) are suppressed in a single ordered pass over each document's detections.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import ascii_lower, documents, whole_text

#: The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The signatures, by hand: ``label = pattern`` over words in lower case with single blanks, in sections by
#: priority. ``{x.y}`` is a version however it is joined to the name, ``{L}`` license or licence, ``{under}`` the
#: start of a notice, ``{later}`` its end; the blank before and after a match is implied.
SIGNATURES = r"""
[name]
gpl = gnu general public {L}
gpl = gnu gpl
gpl = gpl
lgpl = gnu (?:lesser|library) general public {L}
lgpl = (?:gnu )?lgpl
agpl = (?:gnu )?affero general public {L}
agpl = (?:gnu )?agpl
fdl = gnu free documentation {L}
fdl = gfdl
apache = apache (?:software )?{L}
mit = mit {L}
mit = expat {L}
x11 = x11 {L}
mit-0 = mit no attribution
bsd = bsd (?:style |like )?{L}
bsd = berkeley software distribution
0bsd = (?:bsd zero clause|zero clause bsd|0bsd)
bsd-1-clause = (?:bsd 1 clause|1 clause bsd)
bsd-2-clause = (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd {L})
bsd-3-clause = (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)
bsd-4-clause = (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)
isc = isc {L}
mpl = mozilla public {L}
epl = eclipse public {L}
eupl = european union public {L}
cddl = common development and distribution {L}
cpl = common public {L}
cpal = common public attribution {L}
ipl = ibm public {L}
apsl = apple public source {L}
npl = netscape public {L}
qpl = q public {L}
rpl = reciprocal public {L}
spl = sun public {L}
sspl = server side public {L}
artistic = artistic {L}
clartistic = clarified artistic {L}
zlib = (?:zlib|zlib libpng|libpng) {L}
bsl = boost software {L}
busl = business source {L}
elastic = elastic {L}
unlicense = the unlicense
wtfpl = do what the fuck you want to public {L}
psf = (?:python software foundation|psf) {L}
python = cnri python {L}
php = php {L}
ruby = ruby {L}
zpl = zope public {L}
openssl = openssl {L}
postgresql = postgresql {L}
ncsa = (?:university of illinois )?ncsa (?:open source )?{L}
ecl = educational community {L}
ofl = (?:sil )?open font {L}
lppl = latex project public {L}
vim = vim {L}
curl = curl {L}
ftl = freetype (?:project )?{L}
icu = icu {L}
unicode = unicode (?:data files and software )?{L}
w3c = w3c (?:software )?(?:notice and )?{L}
afl = academic free {L}
osl = open software {L}
upl = universal permissive {L}
mulan = mulan (?:psl|permissive software {L})
cecill = cecill(?: [abc])?
ms-pl = microsoft public {L}
ms-rl = microsoft reciprocal {L}
odbl = open database {L}
odc-by = open data commons attribution {L}
pddl = open data commons public domain dedication
dbcl = database contents {L}
ogl = open government {L}
etalab = (?:etalab )?licence ouverte
dl-de = datenlizenz deutschland
cdla = community data {L} agreement
openrail = (?:creativeml )?open ?rail(?: [ms])?
llama = llama (?:[0-9 ]+)?community {L}
cc0 = (?:cc0|cc zero|creative commons zero)
cc-by = creative commons attribution
cc-by-sa = (?:cc by sa|creative commons attribution share ?alike)
cc-by-nc = (?:cc by nc|creative commons attribution non ?commercial)
cc-by-nd = (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)
cc-by-nc-sa = (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)
cc-by-nc-nd = (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)
public-domain = public domain(?! of )
proprietary = (?<! has )(?<! have )(?<! had )(?<! with )all rights reserved
[version]
gpl-1.0 = (?:gpl|gnu general public {L}){1.0}
gpl-2.0 = (?:gpl|gnu general public {L}){2.0}
gpl-3.0 = (?:gpl|gnu general public {L}){3.0}
lgpl-2.0 = (?:lgpl|library general public {L}){2.0}
lgpl-2.1 = (?:lgpl|lesser general public {L}){2.1}
lgpl-3.0 = (?:lgpl|lesser general public {L}){3.0}
agpl-1.0 = (?:agpl|affero general public {L}){1.0}
agpl-3.0 = (?:agpl|affero general public {L}){3.0}
fdl-1.1 = (?:gfdl|free documentation {L}){1.1}
fdl-1.2 = (?:gfdl|free documentation {L}){1.2}
fdl-1.3 = (?:gfdl|free documentation {L}){1.3}
apache-1.0 = apache(?: software)?(?: {L})?{1.0}
apache-1.1 = apache(?: software)?(?: {L})?{1.1}
apache-2.0 = apache(?: software)?(?: {L})?{2.0}
mpl-1.0 = (?:mpl|mozilla public {L}){1.0}
mpl-1.1 = (?:mpl|mozilla public {L}){1.1}
mpl-2.0 = (?:mpl|mozilla public {L}){2.0}
epl-1.0 = (?:epl|eclipse public {L}){1.0}
epl-2.0 = (?:epl|eclipse public {L}){2.0}
eupl-1.0 = (?:eupl|european union public {L}){1.0}
eupl-1.1 = (?:eupl|european union public {L}){1.1}
eupl-1.2 = (?:eupl|european union public {L}){1.2}
cddl-1.0 = (?:cddl|common development and distribution {L}){1.0}
cddl-1.1 = (?:cddl|common development and distribution {L}){1.1}
cpl-1.0 = common public {L}{1.0}
cpal-1.0 = common public attribution {L}{1.0}
ipl-1.0 = ibm public {L}{1.0}
apsl-2.0 = apple public source {L}{2.0}
npl-1.1 = netscape public {L}{1.1}
sspl-1.0 = (?:sspl|server side public {L}){1.0}
artistic-1.0 = artistic {L}{1.0}
artistic-2.0 = artistic {L}{2.0}
bsl-1.0 = boost software {L}{1.0}
busl-1.1 = business source {L}{1.1}
elastic-2.0 = elastic {L}{2.0}
wtfpl-2.0 = wtfpl{2.0}
psf-2.0 = (?:python software foundation|psf) {L}{2.0}
php-3.01 = php {L}(?: version| v)? ?v?3 01
zpl-2.1 = (?:zpl|zope public {L}){2.1}
ecl-2.0 = educational community {L}{2.0}
ofl-1.0 = open font {L}{1.0}
ofl-1.1 = (?:ofl|open font {L}){1.1}
lppl-1.3 = (?:lppl|latex project public {L})(?: version| v)? ?v?1 3[abc]?
afl-2.1 = academic free {L}{2.1}
afl-3.0 = academic free {L}{3.0}
osl-1.0 = open software {L}{1.0}
osl-2.1 = open software {L}{2.1}
osl-3.0 = open software {L}{3.0}
upl-1.0 = universal permissive {L}{1.0}
mulan-2.0 = mulan psl{2.0}
cecill-2.1 = cecill{2.1}
odbl-1.0 = (?:odbl|open database {L}){1.0}
odc-by-1.0 = (?:odc by|open data commons attribution {L}){1.0}
pddl-1.0 = (?:pddl|public domain dedication and {L}){1.0}
ogl-3.0 = open government {L}{3.0}
cdla-permissive-1.0 = cdla permissive{1.0}
cdla-permissive-2.0 = cdla permissive{2.0}
cdla-sharing-1.0 = cdla sharing{1.0}
cc0-1.0 = cc0(?: universal)?{1.0}
cc-by-1.0 = (?:cc by|creative commons attribution)(?: {L})?{1.0}
cc-by-2.0 = (?:cc by|creative commons attribution)(?: {L})?{2.0}
cc-by-2.5 = (?:cc by|creative commons attribution)(?: {L})?{2.5}
cc-by-3.0 = (?:cc by|creative commons attribution)(?: {L})?{3.0}
cc-by-4.0 = (?:cc by|creative commons attribution)(?: {L})?{4.0}
cc-by-sa-2.0 = (?:cc by sa|attribution share ?alike)(?: {L})?{2.0}
cc-by-sa-2.5 = (?:cc by sa|attribution share ?alike)(?: {L})?{2.5}
cc-by-sa-3.0 = (?:cc by sa|attribution share ?alike)(?: {L})?{3.0}
cc-by-sa-4.0 = (?:cc by sa|attribution share ?alike)(?: {L})?{4.0}
cc-by-nc-2.0 = (?:cc by nc|attribution non ?commercial)(?: {L})?{2.0}
cc-by-nc-2.5 = (?:cc by nc|attribution non ?commercial)(?: {L})?{2.5}
cc-by-nc-3.0 = (?:cc by nc|attribution non ?commercial)(?: {L})?{3.0}
cc-by-nc-4.0 = (?:cc by nc|attribution non ?commercial)(?: {L})?{4.0}
cc-by-nd-3.0 = (?:cc by nd|attribution no ?deriv(?:ative)?s)(?: {L})?{3.0}
cc-by-nd-4.0 = (?:cc by nd|attribution no ?deriv(?:ative)?s)(?: {L})?{4.0}
cc-by-nc-sa-2.0 = (?:cc by nc sa|attribution non ?commercial share ?alike)(?: {L})?{2.0}
cc-by-nc-sa-3.0 = (?:cc by nc sa|attribution non ?commercial share ?alike)(?: {L})?{3.0}
cc-by-nc-sa-4.0 = (?:cc by nc sa|attribution non ?commercial share ?alike)(?: {L})?{4.0}
cc-by-nc-nd-3.0 = (?:cc by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: {L})?{3.0}
cc-by-nc-nd-4.0 = (?:cc by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: {L})?{4.0}
[notice]
gpl = {under}(?:gnu )?(?:gpl|general public {L})
gpl-1.0-or-later = (?:gpl|gnu general public {L}){1.0}{later}
gpl-2.0-or-later = (?:gpl|gnu general public {L}){2.0}{later}
gpl-3.0-or-later = (?:gpl|gnu general public {L}){3.0}{later}
gpl-2.0-only = (?:gpl|gnu general public {L}){2.0} only
gpl-3.0-only = (?:gpl|gnu general public {L}){3.0} only
gpl-2.0-or-later = gnu general public {L} as published by the free software foundation either version 2{later}
gpl-3.0-or-later = gnu general public {L} as published by the free software foundation either version 3{later}
gpl-2.0-only = gnu general public {L} version 2 as published by the free software foundation
gpl = everyone is permitted to copy and distribute verbatim copies of this {L} document
gpl = you should have received a copy of the gnu general public {L} along with
lgpl = {under}(?:gnu )?(?:lgpl|(?:lesser|library) general public {L})
lgpl-2.0-or-later = (?:lgpl|library general public {L}){2.0}{later}
lgpl-2.1-or-later = (?:lgpl|lesser general public {L}){2.1}{later}
lgpl-3.0-or-later = (?:lgpl|lesser general public {L}){3.0}{later}
lgpl-2.1-only = (?:lgpl|lesser general public {L}){2.1} only
lgpl-3.0-only = (?:lgpl|lesser general public {L}){3.0} only
lgpl-2.1-or-later = gnu lesser general public {L} as published by the free software foundation either version 2 1{later}
lgpl-3.0-or-later = gnu lesser general public {L} as published by the free software foundation either version 3{later}
lgpl = you should have received a copy of the gnu lesser general public {L} along with
agpl = {under}(?:gnu )?(?:agpl|affero general public {L})
agpl-3.0-or-later = (?:agpl|affero general public {L}){3.0}{later}
agpl-3.0-only = (?:agpl|affero general public {L}){3.0} only
agpl-3.0-or-later = gnu affero general public {L} as published by the free software foundation either version 3{later}
fdl = permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}
apache = {under}apache (?:software )?{L}
apache-2.0 = licensed under the apache {L} version 2 0 the {L} you may not use this file except in compliance with the {L}
apache-2.0 = you may obtain a copy of the {L} at https? www apache org {L}s {L} 2 0
apache-2.0 = www apache org {L}s {L} 2 0
apache-1.1 = this product includes software developed by the apache software foundation
mit = {under}(?:mit|expat) {L}
mit = permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit = the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit = opensource org {L}s mit
x11 = except as contained in this notice the name of the x consortium shall not be used in advertising
bsd = {under}(?:a |an )?bsd(?: style| like)?(?: {L})?
bsd = redistribution and use(?: in source and binary forms| in source form| in binary form)? with or without modification (?:are|is) permitted(?: provided that the following conditions are met| provided)?
bsd-3-clause = neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause = all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-2-clause = the views and conclusions contained in the software and documentation are those of the authors
isc = permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc = {under}(?:the )?isc {L}
0bsd = permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd = permission to use copy modify and distribute this software and its documentation for any purpose
zlib = this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib = altered source versions must be plainly marked as such and must not be misrepresented as being the original software
mpl-2.0 = this source code form is subject to the terms of the mozilla public {L} v 2 0
mpl-1.1 = the contents of this file are subject to the mozilla public {L} version 1 1
mpl = {under}mozilla public {L}
mpl-2.0 = mozilla org mpl 2 0
epl-1.0 = this program and the accompanying materials are made available under the terms of the eclipse public {L} v1 0
epl-2.0 = this program and the accompanying materials are made available under the terms of the eclipse public {L} 2 0
epl = {under}eclipse public {L}
eupl = {under}(?:eupl|european union public {L})
cddl-1.0 = the contents of this file are subject to the terms of the common development and distribution {L}
artistic = {under}(?:the )?(?:clarified )?artistic {L}
artistic = under the same terms as perl itself
bsl-1.0 = distributed under the boost software {L} version 1 0
bsl-1.0 = permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl-1.0 = www boost org {L} 1 0
busl = the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2.0 = you may not provide the software to third parties as a hosted or managed service
sspl-1.0 = if you make the functionality of the program or a modified version available to third parties as a service
unlicense = this is free and unencumbered software released into the public domain
unlicense = unlicense org
wtfpl = everyone is permitted to copy and distribute verbatim or modified copies of this {L} document
wtfpl = you just do what the fuck you want to
psf = psf hereby grants licensee a nonexclusive royalty free world wide {L}
php = this product includes php software freely available from
openssl = this product includes software developed by the openssl project
postgresql = permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa = permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software
ofl-1.1 = this font software is licensed under the sil open font {L} version 1 1
lppl = this work may be distributed and or modified under the conditions of the latex project public {L}
ftl = portions of this software are copyright (?:\S+ ){1,6}the freetype project
w3c = by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
unicode = permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
json = the software shall be used for good not evil
beerware = if we meet some day and you think this stuff is worth it you can buy me a beer
ms-pl = {under}(?:the )?(?:ms pl|microsoft public {L})
ms-rl = {under}(?:the )?(?:ms rl|microsoft reciprocal {L})
odbl-1.0 = opendatacommons org {L}s odbl
odc-by-1.0 = opendatacommons org {L}s by
pddl-1.0 = opendatacommons org {L}s pddl
ogl = contains public sector information licensed under the open government {L}
cc0-1.0 = creativecommons org publicdomain zero 1 0
public-domain = creativecommons org publicdomain mark 1 0
public-domain = (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain = this work is in the public domain
cc-by-2.0 = creativecommons org {L}s by 2 0
cc-by-2.5 = creativecommons org {L}s by 2 5
cc-by-3.0 = creativecommons org {L}s by 3 0
cc-by-4.0 = creativecommons org {L}s by 4 0
cc-by-sa-2.0 = creativecommons org {L}s by sa 2 0
cc-by-sa-3.0 = creativecommons org {L}s by sa 3 0
cc-by-sa-4.0 = creativecommons org {L}s by sa 4 0
cc-by-nc-3.0 = creativecommons org {L}s by nc 3 0
cc-by-nc-4.0 = creativecommons org {L}s by nc 4 0
cc-by-nd-3.0 = creativecommons org {L}s by nd 3 0
cc-by-nd-4.0 = creativecommons org {L}s by nd 4 0
cc-by-nc-sa-3.0 = creativecommons org {L}s by nc sa 3 0
cc-by-nc-sa-4.0 = creativecommons org {L}s by nc sa 4 0
cc-by-nc-nd-3.0 = creativecommons org {L}s by nc nd 3 0
cc-by-nc-nd-4.0 = creativecommons org {L}s by nc nd 4 0
proprietary = this software is (?:the )?(?:confidential and proprietary|proprietary and confidential)
proprietary = proprietary and confidential
proprietary = unauthorized (?:copying|use|reproduction) (?:of this file )?(?:\S+ ){0,8}is strictly prohibited
"""

#: Identifiers that a machine-readable tag may name, alone or in an expression, as their label has them.
TAGS = """
0bsd agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1
cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 cddl-1.0 ecl-2.0 epl-1.0 epl-2.0
eupl-1.2 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0
lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 ms-pl ncsa odbl-1.0 ofl-1.1 openssl postgresql unlicense upl-1.0 wtfpl zlib
"""

#: Priorities: a bare name, a name with its version, a notice or a license's own sentence, a machine-readable tag.
NAME, VERSIONED, NOTICE, TAG = 1, 2, 3, 4
_UNDER = "(?:licensed|released|distributed|available|covered|published) under (?:the )?(?:terms of )?(?:the )?"
_LATER = "(?: or (?:any |at your option any )?later(?: version)?| or newer| at your option any later version)"


def keywords(signature: str) -> list[str]:
    """Of these pieces of words, every match of a signature holds one: the longest that stands outside groups,
    or where none is long, the longest of each alternative of the first group that has to match."""
    plain = re.sub(r"\{under\}", "under ", re.sub(r"\{L\}", "licen ", re.sub(r"\{later\}|\{[0-9.]+\}", "", signature)))
    outside, groups = plain, []
    while (less := re.sub(r"\((?:\?:)?[^()]*\)(?:\{[0-9,]+\}|\?)|[a-z ]\?(?!:)|\[[^\]]*\]\??", "\t", outside)) != outside:
        outside = less
    required = outside
    while m := re.search(r"\((?:\?:)?([^()]*)\)", outside):
        groups.append(m[1])
        outside = outside[: m.start()] + "\t" + outside[m.end() :]
    longest = max(re.split(r"[\t ]+", outside), key=len)
    if len(longest) >= 4 or not groups:
        return [longest]
    first = re.search(r"\(\?:(.*?)\)", required)[1]
    return sorted({max(re.split(r"[\t ]+", alternative), key=len) for alternative in first.split("|")})


def rules() -> list[dict]:
    """The ordered rules: label, pattern, priority and keywords; a text with none of these has no match."""
    out: list[dict] = []

    def add(label: str, pattern: str, priority: int, kws: list[str]) -> None:
        out.append({"label": label, "rx": f"(?<= ){pattern}(?= )", "prio": priority, "kws": kws})

    def version(m: re.Match) -> str:
        major, minor = m[1].split(".")
        return rf"(?: version| ver| v)? ?v?{major}(?: 0)?(?! [0-9] )" if minor == "0" else rf"(?: version| ver| v)? ?v?{major} {minor}"

    sections = {"name": NAME, "version": VERSIONED, "notice": NOTICE}
    for line in SIGNATURES.strip().splitlines():
        if line.startswith("["):
            priority = sections[line[1:-1]]
            continue
        label, pattern = line.split(" = ", 1)
        kws = keywords(pattern)
        pattern = re.sub(r"\{([0-9]+\.[0-9]+)\}", version, pattern)
        add(label, pattern.replace("{L}", "licen[cs]e").replace("{under}", _UNDER).replace("{later}", _LATER), priority, kws)
    for label in TAGS.split():
        words = label.replace("-", " ").replace(".", " ")
        add(label, rf"(?<= spdx license identifier | spdx license identifier [a-z0-9 ]{{1,80}} (?:or|and) ){words}(?! only | or later )", TAG, ["spdx"])
    return out


WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of raw text: what [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ is once A-Z are lower-case
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A text that holds none of these pieces, in whatever case, and no match of ``GATE_WORDS`` has no base phrase
#: and no match of ``rules()``.
GATE = (
    "licen spdx gpl gfdl cc0 cddl eupl wtfpl odbl pddl cdla sspl lppl cecill mulan bsd berkeley apache mozilla creative attribution rail datenlizenz domain "
    "reserved proprietary unauthorized hereby redistribution contributors acknowledg conclusions consortium documentation substantial warranty misrepresented "
    "boost managed functionality freetype openssl php perl evil beer fuck"
).split()
GATE_WORDS = r"(?<![a-z0-9])(?:(?:mpl|epl|zpl|ofl)(?![a-uw-z])|(?:(?:cc|odc){0}(?:by|zero)|ms{0}[pr]l)(?![a-z]))".format(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _spaces(c: str) -> str:
    return f"(length({c}) - length(replace({c}, ' ', '')))"


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_rules (detections that survive suppression).

    Null and empty texts have no words: counts 0, null positions, empty labels, score 0. Repeated rows
    and ids each keep their own row; other columns of ``docs`` are ignored, so none can clash. Long
    texts are scanned whole; finding the places of detections is linear in the text and in their number, and so
    is the pass over them once they are sorted.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("_t"))
    lower = F.lower("_t")
    gated = reduce(lambda a, k: a | F.contains(lower, F.lit(k)), GATE, F.lit(False)) | lower.rlike(GATE_WORDS)
    t = t.select("doc_id", F.regexp_count("_t", F.lit(WORD)).cast("long").alias("n_words"), F.when(gated, F.col("_t")).alias("_t"))
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(ascii_lower(F.col("_t")), F.lit(LOWER_WORD), F.lit(0)), " "), F.lit(" "))
    t = t.select("doc_id", "n_words", F.when(F.col("_t").isNotNull(), padded).alias("_p"))
    # where each base phrase splits the text; a hit's word position follows from the spaces around it
    pieces = {f"_b{k}": F.split("_p", f"(?<= ){phrase}(?= )", -1) for k, phrase in enumerate(BASE_PHRASES)}
    t = t.withColumns(pieces)
    hits, first, last, labels = [], [], [], []
    for k, (phrase, label) in enumerate(BASE_PHRASES.items()):
        hit = F.expr(f"size(_b{k}) > 1")
        hits.append(F.expr(f"coalesce(greatest(size(_b{k}) - 1, 0), 0)"))
        first.append(F.when(hit, F.expr(f"{_spaces(f'_b{k}[0]')} - 1")))
        last.append(F.when(hit, F.expr(f"n_words - ({_spaces(f'element_at(_b{k}, -1)')} - 1) - {len(phrase.split())}")))
        labels.append(F.when(hit, F.lit(label)))
    n_base = sum(hits[1:], hits[0]).cast("long")
    t = t.select(
        "doc_id", "n_words", "_p", n_base.alias("n_base"), F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("_base"), _detections("_p").alias("_found"),
    )
    t = t.withColumn("_kept", _survivors("_found"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base_score = F.when(F.col("n_base") > 0, F.lit(NAME)).otherwise(F.lit(0))
    return t.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("_base")).alias("base_labels"),
        F.coalesce(joined(F.concat("_base", F.col("_kept.labels"))), F.lit("")).alias("labels"),
        (F.greatest(base_score, F.coalesce(F.col("_kept.best"), F.lit(0))) / F.lit(TAG)).cast("double").alias("score"),
        F.coalesce(F.col("_kept.n"), F.lit(0)).cast("long").alias("n_rules"),
    )


OPEN, CLOSE = "\x01", "\x02"  # no part of a word


def _detections(padded: str) -> Column:
    """All matches of all rules whose keyword the text has, as (start, shorter-last key, priority, label); places are
    numbers of words."""
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<label:string,rx:string,prio:int,kws:array<string>>>")
    tried = F.filter(table, lambda r: F.exists(r["kws"], lambda k: F.contains(F.col(padded), k)) & F.rlike(F.col(padded), r["rx"]))

    def places(r: Column) -> Column:
        # matches begin and end between words, so marks put around them stay at the first and the last word, and the
        # words' own numbers are the places: no running sum, and the work is linear in the matches
        marked = F.split(F.regexp_replace(F.col(padded), r["rx"], F.lit(f"{OPEN}$0{CLOSE}")), " ", -1)
        numbered = lambda found: F.array_compact(F.transform(marked, lambda w, i: F.when(found(w), i)))
        ends = F.arrays_zip(numbered(lambda w: F.startswith(w, F.lit(OPEN))).alias("s"), numbered(lambda w: F.endswith(w, F.lit(CLOSE))).alias("e"))
        return F.transform(ends, lambda d: F.struct(d["s"].alias("s"), (-d["e"] - 1).alias("ne"), (-r["prio"]).alias("np"), r["label"].alias("label")))

    return F.array_sort(F.flatten(F.transform(tried, places)))


def _survivors(found: str) -> Column:
    """Ordered pass over detections sorted by (start, longest first, highest priority first): one is
    suppressed if an earlier one ends no sooner and has a higher priority, or an equal one and is longer.
    The state is the furthest end so far for each priority."""
    levels = range(NAME, TAG + 1)
    start = F.struct(
        *[F.lit(-1).alias(f"m{k}") for k in levels], F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"), F.lit(0).alias("n"),
    )

    def step(acc: Column, d: Column) -> Column:
        end, prio = -d["ne"], -d["np"]
        keep = ~F.greatest(*[F.when((F.lit(k) >= prio) & (acc[f"m{k}"] >= end), 1).otherwise(0) for k in levels]).cast("boolean")
        return F.struct(
            *[F.when((prio == k) & (end > acc[f"m{k}"]), end).otherwise(acc[f"m{k}"]).alias(f"m{k}") for k in levels],
            F.when(keep, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(keep, F.greatest(acc["best"], prio)).otherwise(acc["best"]).alias("best"),
            (acc["n"] + keep.cast("int")).alias("n"),
        )

    return F.aggregate(F.col(found), start, step)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {"op1_license_scan": op1_license_scan}
