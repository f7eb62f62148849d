"""The signature rules of the license scan, in order of priority.

A rule is a regular expression over text whose A-Z are lower-cased.  Names
below are written as they appear in running text; the four ways in which a
text refers to a licence are written once and applied to every name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Label, the name as a regular expression, and its identifier in license tags.
NAMES = [
    ("mit", r"mit(?: x11| expat)?", "mit"),
    ("mit-0", r"mit no attribution", "mit-0"),
    ("apache", r"apache(?: software)?(?: license,?)?(?: version)? ?1\.1", "apache-1.1"),
    ("apache", r"apache(?: software)?(?: license,?)?(?: version| v)? ?2(?:\.0)?", "apache-2.0"),
    ("gpl", r"gnu general public", "gpl"),
    ("gpl-2.0", r"gnu general public license,? (?:version|v\.?) ?2(?:\.0)?", "gpl-2.0(?:-only|-or-later|\\+)?"),
    ("gpl-3.0", r"gnu general public license,? (?:version|v\.?) ?3(?:\.0)?", "gpl-3.0(?:-only|-or-later|\\+)?"),
    ("lgpl-2.1", r"gnu lesser general public license,? (?:version|v\.?) ?2\.1", "lgpl-2.1(?:-only|-or-later|\\+)?"),
    ("lgpl-3.0", r"gnu lesser general public license,? (?:version|v\.?) ?3(?:\.0)?", "lgpl-3.0(?:-only|-or-later|\\+)?"),
    ("lgpl", r"gnu (?:lesser|library) general public", "lgpl"),
    ("agpl-3.0", r"gnu affero general public", "agpl-3.0(?:-only|-or-later|\\+)?"),
    ("fdl", r"gnu free documentation", "gfdl-1.[123]"),
    ("bsd-2-clause", r"(?:simplified|2-clause|two-clause) bsd", "bsd-2-clause"),
    ("bsd-3-clause", r"(?:new|modified|revised|3-clause|three-clause) bsd", "bsd-3-clause"),
    ("bsd-4-clause", r"(?:original|old|4-clause|four-clause) bsd", "bsd-4-clause"),
    ("0bsd", r"(?:zero[- ]clause|0-clause) bsd", "0bsd"),
    ("bsd", r"(?:berkeley software distribution|bsd)", "bsd"),
    ("isc", r"(?:internet systems consortium|isc)", "isc"),
    ("mpl-1.1", r"mozilla public license,? (?:version|v\.?) ?1\.1", "mpl-1.1"),
    ("mpl-2.0", r"mozilla public license,? (?:version|v\.?) ?2(?:\.0)?", "mpl-2.0"),
    ("mpl", r"mozilla public", "mpl"),
    ("epl-1.0", r"eclipse public license,? (?:-|version|v\.?) ?1(?:\.0)?", "epl-1.0"),
    ("epl-2.0", r"eclipse public license,? (?:-|version|v\.?) ?2(?:\.0)?", "epl-2.0"),
    ("epl", r"eclipse public", "epl"),
    ("cddl", r"common development and distribution", "cddl-1.[01]"),
    ("cpl", r"common public", "cpl-1.0"),
    ("ipl", r"ibm public", "ipl-1.0"),
    ("eupl", r"european union public", "eupl-1.[12]"),
    ("cecill", r"cecill(?:-[bc])?", "cecill(?:-[bc]|-2.[01])?"),
    ("artistic-1.0", r"artistic license,? (?:version|v\.?)? ?1(?:\.0)?", "artistic-1.0(?:-perl)?"),
    ("artistic-2.0", r"artistic license,? (?:version|v\.?)? ?2(?:\.0)?", "artistic-2.0"),
    ("artistic", r"(?:clarified )?artistic", "artistic"),
    ("zlib", r"zlib(?:/libpng)?", "zlib"),
    ("libpng", r"libpng", "libpng(?:-2.0)?"),
    ("boost", r"boost software", "bsl-1.0"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"do what the f\S* you want to public", "wtfpl"),
    ("cc0", r"creative commons (?:cc0|zero)(?: 1\.0)?(?: universal)?", "cc0-1.0"),
    ("cc-by", r"creative commons attribution(?: [1-4]\.0)?(?: international| unported| generic)?", "cc-by-[1-4].0"),
    ("cc-by-sa", r"creative commons attribution[- ]share[- ]?alike(?: [1-4]\.0)?", "cc-by-sa-[1-4].0"),
    ("cc-by-nd", r"creative commons attribution[- ]no[- ]?deriv\w*(?: [1-4]\.0)?", "cc-by-nd-[1-4].0"),
    ("cc-by-nc", r"creative commons attribution[- ]non[- ]?commercial(?: [1-4]\.0)?", "cc-by-nc-[1-4].0"),
    ("cc-by-nc-sa", r"creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike(?: [1-4]\.0)?", "cc-by-nc-sa-[1-4].0"),
    ("cc-by-nc-nd", r"creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv\w*(?: [1-4]\.0)?", "cc-by-nc-nd-[1-4].0"),
    ("ofl", r"(?:sil )?open font", "ofl-1.1"),
    ("odbl", r"open (?:data commons open )?database", "odbl-1.0"),
    ("pddl", r"public domain dedication and", "pddl-1.0"),
    ("postgresql", r"postgresql", "postgresql"),
    ("python", r"python software foundation", "(?:psf-2.0|python-2.0)"),
    ("php", r"php", "php-3.0[01]?"),
    ("ruby", r"ruby", "ruby"),
    ("openssl", r"openssl", "openssl"),
    ("ssleay", r"ssleay", "ssleay"),
    ("curl", r"curl", "curl"),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", "ncsa"),
    ("afl", r"academic free", "afl-[123].[01]"),
    ("osl", r"open software", "osl-[123].[01]"),
    ("upl", r"universal permissive", "upl-1.0"),
    ("ms-pl", r"microsoft public", "ms-pl"),
    ("ms-rl", r"microsoft reciprocal", "ms-rl"),
    ("beerware", r"beer-?ware", "beerware"),
    ("json", r"json", "json"),
    ("vim", r"vim", "vim"),
    ("w3c", r"w3c(?: software)?(?: notice and)?", "w3c"),
    ("qpl", r"q public", "qpl-1.0"),
    ("sleepycat", r"sleepycat", "sleepycat"),
    ("bsl", r"business source", "busl-1.1"),
    ("sspl", r"server side public", "sspl-1.0"),
    ("elastic", r"elastic", "elastic-2.0"),
    ("hpnd", r"historical permission notice and disclaimer", "hpnd"),
]

# Sentences that stand only in one licence's own text.
SENTENCES = [
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors may be used"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice"),
    ("apache", r"unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("gpl", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", r"you can redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("cc0", r"waive[sd]? all copyright and related or neighboring rights"),
    ("public-domain", r"(?:dedicated|released|placed) (?:to|into|in) the public domain"),
    ("mit", r"the software is provided [\"']?as is[\"']?, without warranty of any kind, express or implied"),
    ("mit", r"to deal in the software without restriction, including without limitation the rights"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim"),
    ("mit-0", r"the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\.(?! subject)"),
    ("isc", r"the author disclaims all warranties with regard to this software"),
    ("0bsd", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.(?! provided)"),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|author) and contributors"),
    ("bsd-4-clause", r"this product includes software developed by .{1,80}? and its contributors"),
    ("apache", r"you may not use this file except in compliance with the license"),
    ("apache", r"grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"),
    ("apache", r"see the license for the specific language governing permissions and limitations"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("gpl", r"either version [23] of the license, or \(at your option\) any later version"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0", r"this general public license does not permit incorporating your program into proprietary programs"),
    ("gpl-3.0", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", r"this license, the lesser general public license, applies to some specially designated software packages"),
    ("lgpl-3.0", r"incorporates the terms and conditions of version 3 of the gnu general public license, supplemented"),
    ("agpl-3.0", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("fdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file, you can obtain one"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", r"the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", r"licensed under the eupl"),
    ("cecill", r"this software is governed by the cecill"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied, modified, distributed"),
    ("zlib", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib", r"altered source versions must be plainly marked as such, and must not be misrepresented"),
    ("libpng", r"the png reference library is supplied [\"']?as is"),
    ("boost", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", r"you just do what the f\S* you want to"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-sa", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("ofl", r"the fonts and derivatives, however, cannot be released under any other type of license"),
    ("ofl", r"no modified version of the font software may use the reserved font name"),
    ("odbl", r"any use of this database must be attributed"),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("python", r"psf is making python available to licensee on an [\"']as is[\"'] basis"),
    ("php", r"products derived from this software may not be called [\"']php[\"']"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("curl", r"except as contained in this notice, the name of a copyright holder shall not be used in advertising"),
    ("ncsa", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers"),
    ("afl", r"licensed under the academic free license"),
    ("upl", r"a royalty-free, perpetual license, .{0,80}? covering (?:both )?the software and any (?:and all )?larger works"),
    ("ms-pl", r"if you use the software, you accept this license\. if you do not accept the license, do not use the software"),
    ("beerware", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    ("json", r"the software shall be used for good, not evil"),
    ("w3c", r"permission to copy, modify, and distribute this (?:software|work) and its documentation, with or without modification, for any purpose and without fee or royalty"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("bsl", r"effective on the change date, or the fourth anniversary of the first publicly available distribution"),
    ("sspl", r"if you make the functionality of the program .{1,80}? available to third parties as a service, you must make the service source code available"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service"),
    ("hpnd", r"appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction) of this (?:file|software|document).{0,40}? is strictly prohibited"),
    ("proprietary", r"confidential and proprietary information of"),
    ("proprietary", r"no part of this (?:publication|book|work) may be reproduced"),
    ("proprietary", r"for internal use only"),
    ("proprietary", r"all rights reserved"),
    ("copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}"),
]

#: How a text refers to a licence, best evidence first: (kind, weight, before the name, after the name).
FORMS = [
    ("granted", 0.9, r"(?:licensed|released|distributed|available|published)(?: to you)? under (?:the )?(?:terms of )?(?:the )?", r"(?: license| licence)?"),
    ("named", 0.6, r"", r" (?:license|licence)"),
    ("see", 0.4, r"(?:see|read|under|per) (?:the )?", r" (?:license|licence) (?:file|text|terms|for details)"),
]


@dataclass(frozen=True)
class Signature:
    label: str
    kind: str
    weight: float
    pattern: re.Pattern
    keywords: tuple[str, ...]


def literal(pattern: str) -> str:
    """The longest run of letters and digits that every match of the pattern holds; empty if it has none of three.

    Groups, classes and whatever a quantifier may leave out are skipped, and
    so is a pattern with alternatives outside of groups.
    """
    depth, at, run, best = 0, 0, "", ""
    while at <= len(pattern):
        c = pattern[at : at + 1]
        if depth == 0 and c in ("?", "*", "{"):
            run = run[:-1]
        if depth or not (c.isascii() and c.isalnum()):
            best, run = max(best, run, key=len), ""
        else:
            run += c
        if c == "|" and not depth:
            return ""
        if c == "\\":
            at += 1
        elif c == "[":
            at = pattern.index("]", at + 2)
        depth += (c == "(") - (c == ")")
        at += 1
    return best if len(best) > 2 else ""


def _build() -> list[Signature]:
    edge = r"(?<![a-z0-9])", r"(?![a-z0-9])"
    out = [Signature(label, "tag", 1.0, re.compile(rf"spdx-license-identifier:\s*{tag}{edge[1]}"), ("spdx", literal(tag))) for label, _, tag in NAMES]
    out += [Signature(label, "sentence", 0.95, re.compile(text.replace(" ", r"\s+")), (literal(text),)) for label, text in SENTENCES]
    for kind, weight, before, after in FORMS:
        for label, name, _ in NAMES:
            word = "under" if kind == "granted" else "licen"
            out.append(Signature(label, kind, weight, re.compile((edge[0] + before + name + after + edge[1]).replace(" ", r"\s+")), (word, literal(name))))
    return out


#: In order of priority: tags, sentences of a licence's own text, then the ways in which a text refers to a name.
SIGNATURES = _build()
