"""License scans by ordered signature rules.

A text is reduced to its words (A-Z in lower case, WORD_PATTERN) joined by single blanks. Rules are
regular expressions over that, in order of priority, each with the keywords of which one must be
in the text for the rule to be tried. Detections are then resolved: one that lies inside the span
of another is suppressed by it if the other is longer, or as long and of a rule of higher priority
(lower rank). Spans that merely overlap both stay. Places of the three base phrases are counted
beside that and their labels are never suppressed.

Some two hundred rules are written one by one: sentences of the licenses' own texts (SENTENCES), and
short notices (NOTICES). For licenses that are cited by name and version, the rules of the versions and of
the forms in which notices cite them follow from one line each (FAMILIES, CC_PARTS).

Defined results: null and empty texts have no words, no places, null first and last words, empty
labels and score 0; repeated rows each get their row; other columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loxodrome.llm.arrow_rows import added

#: Phrases and their labels, matched at every place.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


@dataclass(frozen=True)
class Rule:
    """rank: place in the order of priority; keywords: one of them must be in the text."""

    rank: int
    label: str
    pattern: str
    keywords: tuple[str, ...]
    weight: float


def _v(version: str) -> str:
    """A version as words: its numbers apart, a trailing 0 left out or not."""
    parts = version.split(".")
    if parts[-1] == "0":
        return " ".join(parts[:-1]) + "(?: 0)?"
    return " ".join(parts)


#: Label stem, pattern of the name in full, pattern of the short name (as in identifiers), keywords, versions.
FAMILIES: list[tuple[str, str, str, tuple[str, ...], tuple[str, ...]]] = [
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "agpl", ("affero", "agpl"), ("1.0", "3.0")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl", ("lesser", "library general", "lgpl"), ("2.0", "2.1", "3.0")),
    ("gpl", "(?:gnu )?general public licen[cs]e", "gpl", ("general public", "gpl"), ("1.0", "2.0", "3.0")),
    ("gfdl", "(?:gnu )?free documentation licen[cs]e", "gfdl", ("free documentation", "gfdl"), ("1.1", "1.2", "1.3")),
    ("apache", "apache (?:software )?licen[cs]e", "apache", ("apache",), ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla public licen[cs]e", "mpl", ("mozilla public", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public licen[cs]e", "epl", ("eclipse public", "epl"), ("1.0", "2.0")),
    ("cpl", "common public licen[cs]e", "cpl", ("common public", "cpl"), ("1.0",)),
    ("cddl", "common development and distribution licen[cs]e", "cddl", ("common development", "cddl"), ("1.0", "1.1")),
    ("eupl", "european union public licen[cs]e", "eupl", ("european union public", "eupl"), ("1.0", "1.1", "1.2")),
    ("osl", "open software licen[cs]e", "osl", ("open software", "osl"), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free licen[cs]e", "afl", ("academic free", "afl"), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic licen[cs]e", "artistic", ("artistic",), ("1.0", "2.0")),
    ("bsl", "boost software licen[cs]e", "bsl", ("boost software", "bsl"), ("1.0",)),
    ("busl", "business source licen[cs]e", "busl", ("business source", "busl"), ("1.1",)),
    ("sspl", "server side public licen[cs]e", "sspl", ("server side", "sspl"), ("1.0",)),
    ("elastic", "elastic licen[cs]e", "elastic", ("elastic",), ("1.0", "2.0")),
    ("ecl", "educational community licen[cs]e", "ecl", ("educational community", "ecl"), ("1.0", "2.0")),
    ("efl", "eiffel forum licen[cs]e", "efl", ("eiffel", "efl"), ("1.0", "2.0")),
    ("lppl", "latex project public licen[cs]e", "lppl", ("latex project", "lppl"), ("1.0", "1.1", "1.2", "1.3")),
    ("ofl", "(?:sil )?open font licen[cs]e", "ofl", ("open font", "ofl"), ("1.0", "1.1")),
    ("php", "php licen[cs]e", "php", ("php",), ("3.0", "3.01")),
    ("python", "python (?:software foundation )?licen[cs]e", "psf", ("python", "psf"), ("2.0", "2.0.1")),
    ("qpl", "q public licen[cs]e", "qpl", ("q public", "qpl"), ("1.0",)),
    ("rpl", "reciprocal public licen[cs]e", "rpl", ("reciprocal public", "rpl"), ("1.1", "1.5")),
    ("upl", "universal permissive licen[cs]e", "upl", ("universal permissive", "upl"), ("1.0",)),
    ("zpl", "zope public licen[cs]e", "zpl", ("zope", "zpl"), ("1.1", "2.0", "2.1")),
    ("cecill", "cecill(?: free software)? licen[cs]e", "cecill", ("cecill",), ("1.0", "1.1", "2.0", "2.1")),
    ("cpal", "common public attribution licen[cs]e", "cpal", ("public attribution", "cpal"), ("1.0",)),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl", ("microsoft public", "ms pl"), ("1.0",)),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl", ("microsoft reciprocal", "ms rl"), ("1.0",)),
    ("odbl", "open (?:data commons open )?database licen[cs]e", "odbl", ("database licen", "odbl"), ("1.0",)),
    ("odc-by", "open data commons attribution licen[cs]e", "odc by", ("data commons attribution", "odc by"), ("1.0",)),
    ("pddl", "public domain dedication and licen[cs]e", "pddl", ("public domain dedication", "pddl"), ("1.0",)),
    ("ogl-uk", "open government licen[cs]e", "ogl uk", ("open government", "ogl"), ("1.0", "2.0", "3.0")),
    ("etalab", "(?:etalab )?(?:licence ouverte|open licence)", "etalab", ("licence ouverte", "open licence", "etalab"), ("1.0", "2.0")),
    ("mulanpsl", "mulan permissive software licen[cs]e", "mulanpsl", ("mulan",), ("1.0", "2.0")),
    ("vim", "vim licen[cs]e", "vim", ("vim licen", "identifier vim"), ()),
    ("unicode", "unicode (?:dfs|terms|licen[cs]e)(?: \\d+)?", "unicode dfs", ("unicode",), ("2015", "2016")),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", ("zlib",), ()),
    ("isc", "isc licen[cs]e", "isc", ("isc licen", "identifier isc"), ()),
    ("ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[cs]e", "ncsa", ("ncsa",), ()),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "wtfpl", ("wtfpl", "do what the f"), ("1.0", "2.0")),
    ("postgresql", "postgresql licen[cs]e", "postgresql", ("postgresql licen", "identifier postgresql"), ()),
    ("openssl", "openssl licen[cs]e", "openssl", ("openssl",), ()),
    ("ruby", "ruby licen[cs]e", "ruby", ("ruby licen", "identifier ruby"), ()),
    ("json", "json licen[cs]e", "json", ("json licen", "identifier json"), ()),
    ("blueoak", "blue oak model licen[cs]e", "blueoak", ("blue oak", "blueoak"), ("1.0.0",)),
    ("hippocratic", "hippocratic licen[cs]e", "hippocratic", ("hippocratic",), ("1.2", "2.0", "2.1", "3.0")),
    ("parity", "parity public licen[cs]e", "parity", ("parity",), ("6.0", "7.0")),
    ("polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial) licen[cs]e", "polyform", ("polyform",), ("1.0.0",)),
    ("openrail", "(?:creativeml )?open ?rail(?: [ms]+)? licen[cs]e", "openrail", ("openrail", "open rail"), ()),
    ("llama", "llama \\d? ?community licen[cs]e", "llama community", ("llama",), ("2", "3")),
]
#: Parts that Creative Commons licenses are made of, and what they are called in full.
CC_PARTS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Single notices: label, pattern, keywords.
NOTICES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("hereby granted",)),
    ("mit", "the software is provided as is without warranty of any kind", ("provided as is",)),
    ("mit", "(?:under|by|with) (?:the )?(?:terms of )?(?:the )?(?:mit|expat|x11) licen[cs]e", ("mit licen", "expat", "x11")),
    ("mit", "(?:the )?mit licen[cs]e", ("mit licen",)),
    ("mit", "spdx license identifier (?:mit|x11)", ("spdx",)),
    ("mit-0", "(?:mit no attribution|spdx license identifier mit 0)", ("mit no attribution", "spdx")),
    ("bsd-0", "(?:bsd zero clause|zero clause bsd|0bsd|bsd 0 clause)", ("bsd", "0bsd")),
    ("bsd-1", "(?:bsd 1 clause|1 clause bsd)", ("bsd",)),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", ("bsd", "freebsd")),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)(?: licen[cs]e)?", ("bsd",)),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", ("bsd",)),
    ("bsd", "bsd (?:style )?licen[cs]e", ("bsd",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    ("bsd-3", "neither the name of .{1,80}? nor the names of its contributors", ("neither the name",)),
    ("bsd-4", "all advertising materials mentioning features or use of this software", ("advertising materials",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("unlicense", "(?:the )?unlicense(?:d under the unlicense)?", ("unlicense",)),
    ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1(?: 0)?)?(?: universal)?", ("cc0", "cc zero", "commons zero")),
    ("public-domain", "(?:released|dedicated|placed) (?:in|in|to|into) the public domain", ("public domain",)),
    ("public-domain", "(?:is|are) in the public domain", ("public domain",)),
    ("creative-commons", "creative commons(?: licen[cs]e)?", ("creative commons",)),
    ("copyleft", "copyleft", ("copyleft",)),
    ("gpl-or-later", "either version \\d(?: \\d)? of the license or at your option any later version", ("any later version",)),
    ("gpl", "distributed in the hope that it will be useful but without any warranty", ("hope that it will be useful",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", ("agreed to in writing",)),
    ("apache-2.0", "apache org licenses license 2 0", ("apache org",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("source code form",)),
    ("gpl", "(?:gnu org|fsf org) licen[cs]es(?: gpl(?: \\d(?: \\d)?)?)?", ("gnu org", "fsf org")),
    ("copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*", ("copyright",)),
    ("copyright", "copyright (?:c|by|holders?|notice|owners?)", ("copyright",)),
    ("copyright", "© ?(?:19|20)\\d\\d", ("©",)),
    ("reserved", "(?:all|some|no) rights (?:are )?reserved", ("rights",)),
    ("reserved", "tous droits r[ée]serv[ée]s", ("droits",)),
    ("reserved", "alle rechte vorbehalten", ("rechte",)),
    ("reserved", "(?:todos|reservados todos) los derechos(?: reservados)?", ("derechos",)),
    ("reserved", "reproduction (?:in whole or in part )?(?:without .{1,30}? )?(?:is )?(?:strictly )?(?:prohibited|forbidden)", ("reproduction",)),
    ("proprietary", "(?:proprietary|confidential) and (?:proprietary|confidential)", ("proprietary", "confidential and")),
    ("proprietary", "(?:unauthori[sz]ed|unlicen[cs]ed) (?:copying|use|reproduction|distribution)", ("unauthori", "unlicen")),
    ("proprietary", "end user licen[cs]e agreement", ("end user",)),
    ("proprietary", "may not be (?:copied|reproduced|published|broadcast|redistributed)", ("may not be",)),
    ("noncommercial", "(?:for )?(?:non ?commercial|personal|research|academic|educational) (?:use|purposes) only", ("use only", "purposes only")),
    ("fair-use", "fair (?:use|dealing)", ("fair use", "fair dealing")),
    ("terms", "(?:terms of (?:use|service)|terms and conditions)", ("terms",)),
    ("licensed", "(?:is|are) (?:dual |multi )?licen[cs]ed under", ("licensed under", "licenced under")),
]

#: Sentences of the licenses' own texts and of the notices that their authors ask for.
SENTENCES: list[tuple[str, str, tuple[str, ...]]] = [
    # permissive
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", ("without restriction",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice",)),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", ("copyright holders be liable",)),
    ("mit-feh", "the above copyright notice and this permission notice shall be included in all copies of the software(?: its| and its)? documentation", ("permission notice",)),
    ("mit-modern", "the above copyright notice shall be included in all copies or substantial portions of the software and its documentation", ("substantial portions",)),
    ("x11", "except as contained in this notice the name of .{1,80}? shall not be used in advertising or otherwise to promote the sale", ("contained in this notice",)),
    ("bsd", "redistributions of source code must retain the above copyright notice(?: this list of conditions)?", ("redistributions of source",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", ("redistributions in binary",)),
    ("bsd", "this software is provided by .{1,80}? as is and any express or implied warranties", ("express or implied warranties",)),
    ("bsd-3-clear", "no express or implied licenses to any party s patent rights are granted by this license", ("patent rights",)),
    ("bsd-3-nuclear", "you acknowledge that this software is not designed (?:licensed )?or intended for use in the design construction operation or maintenance of any nuclear facility", ("nuclear facility",)),
    ("bsd-2-patent", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license", ("receiving rights",)),
    ("bsd-protection", "modified copies (?:and|or) derived works must be licensed under the bsd protection license", ("bsd protection",)),
    ("isc", "the software is provided as is and .{1,60}? disclaims all warranties with regard to this software", ("disclaims all warranties",)),
    ("isc", "with or without fee is hereby granted provided that the above copyright notice", ("with or without fee",)),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", ("permission to use",)),
    ("hpnd", "makes no representations about the suitability of this software for any purpose", ("no representations about",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("authors be held liable",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("plainly marked",)),
    ("zlib", "the origin of this software must not be misrepresented", ("must not be misrepresented",)),
    ("zlib", "this notice may not be removed or altered from any source distribution", ("removed or altered",)),
    ("libpng", "the png reference library is supplied as is", ("png reference",)),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission notice appear",)),
    ("ntp", "the university of delaware makes no representations", ("university of delaware",)),
    ("icu", "international business machines corporation and others all rights reserved", ("business machines",)),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty", ("in any medium",)),
    ("fsful", "this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", ("unlimited permission",)),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", ("whatever you want with",)),
    ("beerware", "you can buy me a beer in return", ("a beer in return",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", ("verbatim or modified",)),
    ("wtfpl", "you just do what the fuck you want to", ("do what the f",)),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation", ("authors hereby grant",)),
    ("vim", "there are no restrictions on distributing unmodified copies of vim", ("copies of vim",)),
    ("ncsa", "neither the names of .{1,80}? nor the names of its contributors may be used to endorse or promote products", ("neither the names",)),
    ("afl", "licensed under the academic free license version", ("academic free",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ("person or organization",)),
    ("boost", "unless such copies or derivative works are solely in the form of machine executable object code", ("machine executable object",)),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance",)),
    ("apache-2.0", "you may obtain a copy of the license at", ("obtain a copy of the license",)),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", ("contributor hereby grants",)),
    ("apache-2.0", "if the work includes a notice text file as part of its distribution", ("notice text file",)),
    ("apache-1.1", "this product includes software developed by the apache software foundation", ("apache software foundation",)),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", ("openssl",)),
    ("ssleay", "this product includes cryptographic software written by eric young", ("eric young",)),
    ("ssleay", "this library is free for commercial and non commercial use as long as the following conditions are aheared to", ("aheared to",)),
    ("php", "this product includes php software freely available from", ("php software",)),
    ("python", "this license agreement is between the python software foundation", ("python software foundation",)),
    ("python", "psf is making python available to licensee on an as is basis", ("psf is making",)),
    ("python-cnri", "corporation for national research initiatives", ("national research initiatives",)),
    ("python-beopen", "beopen python open source license agreement", ("beopen",)),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction", ("verbatim copies of the source",)),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", ("intent of this document",)),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("changing it is not allowed",)),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", ("given free software package",)),
    ("postgresql", "postgresql database management system formerly known as postgres", ("formerly known as postgres",)),
    ("postgresql", "without a written agreement is hereby granted provided that the above copyright notice", ("without a written agreement",)),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", ("unicode data files",)),
    ("json", "the software shall be used for good not evil", ("good not evil",)),
    ("upl", "the lesser of the larger works and the software|the larger works to which the software is contributed", ("larger works",)),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", ("governs use of the accompanying",)),
    ("ms-rl", "reciprocal grants for any file you distribute that contains code from the software", ("reciprocal grants",)),
    ("blueoak", "this license gives everyone as much permission to work with this software as possible while protecting contributors from liability", ("as much permission",)),
    ("mulanpsl", "you can use this software according to the terms and conditions of the mulan psl", ("mulan psl",)),
    # public domain and dedications
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", ("anyone is free to copy",)),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", ("copyright interest",)),
    ("cc0", "to the extent possible under law .{1,120}? waived all copyright and related or neighboring rights", ("neighboring rights",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("with this deed",)),
    ("cc0", "certain owners wish to permanently relinquish those rights to a work", ("permanently relinquish",)),
    ("public-domain", "no copyright is claimed and the software may be freely used", ("no copyright is claimed",)),
    ("public-domain", "this (?:work|file|code|software|document|text) (?:has been|was|is hereby) (?:released|dedicated|placed) (?:in|into|to) the public domain", ("public domain",)),
    ("public-domain", "work of the (?:united states|u s) government", ("states government", "u s government")),
    ("public-domain", "the author disclaims copyright to this source code", ("disclaims copyright",)),
    ("public-domain-mark", "public domain mark(?: 1 0)?", ("public domain mark",)),
    ("pddl", "the person or persons who have associated their work with this document the dedicator", ("the dedicator",)),
    # copyleft
    ("gpl", "this program is free software(?: you|:)? (?:you )?can redistribute it and or modify it", ("program is free software",)),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|library|software|file)", ("received a copy of the gnu general",)),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", ("freedom to share",)),
    ("gpl", "gnu general public license for more details", ("license for more details",)),
    ("gpl-2.0", "we protect your rights with two steps 1 copyright the software and 2 offer you this license", ("protect your rights with two",)),
    ("gpl-3.0", "developers that use the gnu gpl protect your rights with two steps 1 assert copyright on the software", ("assert copyright on",)),
    ("gpl-3.0", "a user product is either 1 a consumer product which means any tangible personal property", ("a user product",)),
    ("gpl-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work", ("making a combined work",)),
    ("gpl-gcc-exception", "gcc runtime library exception", ("runtime library exception",)),
    ("gpl-font-exception", "if you create a document which uses this font and embed this font", ("embed this font",)),
    ("gpl-autoconf-exception", "as a special exception to the gnu general public license if you distribute this file as part of a program", ("as a special exception",)),
    ("gpl-linking-exception", "permission to link (?:or combine )?(?:this program|the code of portions of this program) with the openssl", ("permission to link",)),
    ("gpl-syscall-note", "this copyright does not cover user programs that use kernel services by normal system calls", ("normal system calls",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library)", ("library is free software",)),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", ("received a copy of the gnu l",)),
    ("lgpl-2.1", "this license the lesser general public license applies to some specially designated software packages", ("specially designated",)),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", ("incorporates the terms",)),
    ("agpl", "you should have received a copy of the gnu affero general public license", ("affero",)),
    ("agpl-3.0", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", ("interacting with it remotely",)),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("modify this document",)),
    ("gfdl-invariant", "with no invariant sections(?: no| with no) front cover texts", ("invariant sections",)),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version", ("contents of this file",)),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations", ("specific language governing",)),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", ("copy of the mpl",)),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses as defined by the mozilla public license", ("incompatible with secondary",)),
    ("npl", "the contents of this file are subject to the netscape public license", ("netscape public",)),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license agreement", ("accompanying program",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("accompanying materials",)),
    ("epl", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", ("constitutes recipient s acceptance",)),
    ("ibm-pl", "ibm public license(?: version)?(?: 1(?: 0)?)?", ("ibm public",)),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development",)),
    ("cddl", "when distributing covered code include this cddl header in each file", ("cddl",)),
    ("cpal", "the contents of this file are subject to the common public attribution license", ("public attribution",)),
    ("eupl", "licensed under the eupl(?: version)?", ("eupl",)),
    ("eupl", "this european union public licence the eupl applies to the work", ("the eupl applies",)),
    ("cecill", "ce logiciel est r[ée]gi par la licence cecill", ("licence cecill",)),
    ("cecill", "this software is governed by the cecill(?: [a-c])? license", ("cecill",)),
    ("osl", "licensed under the open software license version", ("open software",)),
    ("qpl", "this license applies to any software containing a notice placed by the copyright holder saying that it may be distributed under the terms of the q public license", ("q public",)),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software", ("for the db software",)),
    ("watcom", "sybase open watcom public license", ("open watcom",)),
    ("apsl", "apple public source license", ("apple public source",)),
    ("rpsl", "realnetworks public source license", ("realnetworks public",)),
    ("nasa", "nasa open source agreement(?: version)?(?: 1(?: 3)?)?", ("nasa open source",)),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license", ("latex project",)),
    ("lppl", "this work has the lppl maintenance status", ("lppl maintenance",)),
    ("ofl", "this font software is licensed under the sil open font license", ("font software is licensed",)),
    ("ofl", "the fonts and derivatives however cannot be released under any other type of license", ("the fonts and derivatives",)),
    ("ofl", "no modified version of the font software may use the reserved font name", ("reserved font name",)),
    ("ubuntu-font", "ubuntu font licen[cs]e", ("ubuntu font",)),
    ("bitstream-vera", "bitstream vera is a trademark of bitstream inc", ("bitstream vera",)),
    # data and content
    ("cc-by", "this work is licensed under (?:a|the) creative commons attribution", ("work is licensed under",)),
    ("creative-commons", "some rights reserved this work is licensed under a creative commons", ("some rights reserved",)),
    ("creative-commons", "to view a copy of this license visit", ("to view a copy of this license",)),
    ("creative-commons", "send a letter to creative commons", ("letter to creative commons",)),
    ("creative-commons", "cet(?:te)? (?:œuvre|oeuvre) est mise? à disposition selon les termes de la licence creative commons", ("licence creative commons",)),
    ("creative-commons", "dieses werk ist lizenziert unter einer creative commons", ("lizenziert unter einer",)),
    ("creative-commons", "esta obra está bajo una licencia (?:de )?creative commons", ("bajo una licencia",)),
    ("odbl", "this .{1,60}? is made available under the open database license", ("open database",)),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents license", ("database contents license",)),
    ("osm", "© ?openstreetmap contributors|openstreetmap contributors", ("openstreetmap contributors", "©")),
    ("cdla-permissive", "community data license agreement permissive(?: version)?(?: [12] 0)?", ("community data license",)),
    ("cdla-sharing", "community data license agreement sharing(?: version)?(?: 1 0)?", ("community data license",)),
    ("odc-by", "this .{1,60}? is made available under the open data commons attribution license", ("data commons attribution",)),
    ("ogl-uk", "contains public sector information licensed under the open government licen[cs]e", ("public sector information",)),
    ("dl-de-by", "datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?", ("datenlizenz deutschland",)),
    ("dl-de-zero", "datenlizenz deutschland zero(?: version)?(?: 2 0)?", ("datenlizenz deutschland",)),
    ("etalab", "licence ouverte version", ("licence ouverte",)),
    ("wikipedia", "text is available under the creative commons attribution share ?alike license", ("text is available under",)),
    ("stack-exchange", "user contributions licensed under cc by sa", ("user contributions licensed",)),
    ("project-gutenberg", "this e ?book is for the use of anyone anywhere", ("anyone anywhere",)),
    ("project-gutenberg", "project gutenberg (?:tm )?license", ("project gutenberg",)),
    # source-available and models
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", ("non production use",)),
    ("busl-1.1", "effective on the change date or the fourth anniversary of the first publicly available distribution", ("on the change date",)),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service", ("third parties as a service",)),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", ("hosted or managed service",)),
    ("commons-clause", "the license does not grant to you and you are not granted the right to sell the software|the grant of rights under the license will not include and the license does not grant to you the right to sell the software", ("right to sell the software",)),
    ("commons-clause", "commons clause(?: license)?(?: condition)?", ("commons clause",)),
    ("polyform-noncommercial", "any noncommercial purpose is a permitted purpose", ("noncommercial purpose",)),
    ("prosperity", "prosperity public license", ("prosperity public",)),
    ("confluent", "confluent community license", ("confluent community",)),
    ("timescale", "timescale license agreement", ("timescale license",)),
    ("openrail", "you agree not to use the model or derivatives of the model", ("derivatives of the model",)),
    ("openrail", "use based restrictions as referenced in paragraph 5", ("use based restrictions",)),
    ("llama", "you will not use the llama materials or any output or results", ("llama materials",)),
    ("hippocratic", "the software must not be used by any person or entity for any systems activities or other uses that violate any human rights laws", ("human rights laws",)),
    # reserved rights and terms
    ("proprietary", "this (?:software|document|material|work) is (?:the )?(?:proprietary|confidential)", ("is the proprietary", "is the confidential", "is proprietary", "is confidential")),
    ("proprietary", "contains (?:confidential|proprietary) (?:information|material)|contains trade secrets", ("contains confidential", "contains proprietary", "contains trade")),
    ("proprietary", "no part of this (?:publication|book|document|work|website) may be reproduced", ("no part of this",)),
    ("proprietary", "any unauthori[sz]ed (?:use|copying|duplication|distribution|disclosure)", ("unauthori",)),
    ("proprietary", "licensed material property of", ("licensed material",)),
    ("proprietary", "this software is licensed and not sold|the software is licensed not sold", ("licensed and not sold", "licensed not sold")),
    ("proprietary", "you may not (?:reverse engineer|decompile|disassemble)", ("you may not",)),
    ("evaluation", "for (?:evaluation|trial|demonstration) (?:use|purposes) only", ("evaluation", "trial", "demonstration")),
    ("permission-required", "(?:without|with) (?:the )?(?:prior |express )*(?:written )?(?:permission|consent) of (?:the )?(?:publisher|author|copyright (?:holder|owner)|owner)", ("permission of", "consent of")),
    ("permission-required", "reprinted with (?:the )?(?:kind )?permission", ("reprinted with",)),
    ("trademark", "(?:is a|are) (?:registered )?trademarks? of", ("trademark",)),
    ("noncommercial", "(?:no|not for|non) commercial use(?: (?:allowed|permitted|only))?", ("commercial use",)),
    ("attribution", "(?:provided|as long as|so long as) (?:that )?(?:the )?(?:original )?(?:author|source) is (?:credited|cited|acknowledged)", ("is credited", "is cited", "is acknowledged")),
    ("reserved", "tous droits de reproduction r[ée]serv[ée]s", ("droits de reproduction",)),
    ("reserved", "nachdruck(?: auch auszugsweise)? (?:verboten|nur mit genehmigung)", ("nachdruck",)),
    ("reserved", "prohibida (?:la|su) reproducci[óo]n(?: total| parcial)?", ("prohibida",)),
    ("reserved", "tutti i diritti(?: sono)? riservati", ("diritti",)),
    ("reserved", "todos os direitos reservados", ("direitos",)),
    ("reserved", "все права защищены", ("права",)),
]


def _rules() -> list[Rule]:
    found: list[tuple[str, str, tuple[str, ...], float]] = []
    head = "(?:spdx )?(?:licen[cs]e )?identifier"
    for stem, full, short, keys, versions in FAMILIES:
        for version in versions:  # the most telling forms come first
            v = _v(version)
            found.append((f"{stem}-{version}", f"{head} {short} ?v?{v}(?: (?:only|or later))?", keys, 1.0))
            found.append((f"{stem}-{version}", f"(?:licen[cs]ed|distributed|released|made available|available|published) under (?:the )?(?:terms of )?(?:the )?{full}(?: {short})? (?:version |v ?|{short} )?{v}(?: or (?:any )?later(?: version)?)?", keys, 1.0))
            found.append((f"{stem}-{version}", f"{full}(?: {short})? (?:version |v ?)?{v}(?: or (?:any )?later(?: version)?)?", keys, 0.9))
            found.append((f"{stem}-{version}", f"{short} ?(?:version |v ?)?{v}(?: (?:only|or later))?", keys, 0.6))
        found.append((stem, f"{head} {short}", keys, 0.8))
        found.append((stem, f"(?:licen[cs]ed|distributed|released|made available|available|published) under (?:the )?(?:terms of )?(?:the )?{full}", keys, 0.8))
        found.append((stem, full, keys, 0.7))
    for part, full in CC_PARTS.items():
        short = part.replace("-", " ")
        for version in CC_VERSIONS:
            v = _v(version)
            found.append((f"cc-{part}-{version}", f"(?:creative commons |cc ){full} {v}(?: (?:international|unported|generic))?(?: licen[cs]e)?", ("creative commons", "cc "), 1.0))
            found.append((f"cc-{part}-{version}", f"cc {short} {v}(?: (?:international|unported|generic))?", ("cc by",), 0.9))
            found.append((f"cc-{part}-{version}", f"creativecommons org licenses {short} {v}", ("creativecommons",), 1.0))
        found.append((f"cc-{part}", f"(?:creative commons |cc ){full}(?: licen[cs]e)?", ("creative commons", "cc "), 0.8))
        found.append((f"cc-{part}", f"cc {short}", ("cc by",), 0.7))
    found += [(label, pattern, keys, 0.5) for label, pattern, keys in SENTENCES + NOTICES]
    return [Rule(i, label, rf"(?<= )(?:{pattern})(?= )", keys, w) for i, (label, pattern, keys, w) in enumerate(found)]


RULES = _rules()


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rank: int
    label: str
    weight: float


def resolved(found: list[Detection]) -> list[Detection]:
    """The detections that lie in no longer span, nor in an equal one of a rule of higher priority; in text order."""
    # sorted so that whatever can contain a span comes before it; a span is contained if an earlier one ends no sooner
    out, reach = [], -1
    for d in sorted(set(found), key=lambda d: (d.start, -d.end, d.rank)):
        if d.end > reach:
            out.append(d)
            reach = d.end
    return out


class Scanner:
    """Compiled rules under their keywords."""

    def __init__(self, rules: list[Rule] = RULES):
        self.rules = [(r, re.compile(r.pattern)) for r in rules]
        keys: dict[bytes, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:  # each begins a word
                keys.setdefault(b" " + k.encode(), []).append(i)
        self.keys = keys
        self.base = [(f" {p} ".encode(), label) for p, label in BASE]

    def detections(self, words: bytes) -> list[Detection]:
        """All detections of the rules in words joined by blanks, with a blank before and after, resolved. Spans are in code points."""
        tried = {i for k, rules in self.keys.items() if k in words for i in rules}
        if not tried:
            return []
        text = words.decode("utf-8", "replace")
        return resolved([Detection(*m.span(), i, self.rules[i][0].label, self.rules[i][0].weight) for i in sorted(tried) for m in self.rules[i][1].finditer(text)])

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        parts = text.translate(_WORDS).split()
        words = b" %s " % b" ".join(parts)
        starts, base = [], set()
        for phrase, label in self.base:
            at, last, n = words.find(phrase), 0, 0
            while at >= 0:
                n += words.count(b" ", last, at)  # blanks are counted from the last place on
                starts.append(n)
                base.add(label)
                last, at = at, words.find(phrase, at + 1)
        found = self.detections(words)
        labels = sorted(base | {d.label for d in found})
        score = max([1.0 if base else 0.0, *[d.weight for d in found]])
        return len(parts), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), score


#: Of UTF-8: A-Z in lower case, a blank for every byte that is in no word.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scanned(docs: DataFrame) -> DataFrame:
    """row (the columns of docs but text) and what Scanner.scan() finds."""
    fields = [("n_words", "bigint", pa.int64()), ("n_base", "bigint", pa.int64()), ("first_word", "bigint", pa.int64()), ("last_word", "bigint", pa.int64()), ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64())]

    def make():
        scanner = Scanner()
        return lambda texts: list(zip(*[scanner.scan(t or b"") for t in texts], strict=True)) if texts else [[] for _ in fields]

    return added(docs, "text", fields, make)
