"""License notices found by ordered signature rules over a text's words."""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts, with_columns

# The phrases that always count, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Bytes to words: A-Z in lower case, other ASCII than letters and digits a space, all else kept.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


class Rule(NamedTuple):
    """A signature over words joined by single spaces; it is tried only in texts that hold ``keyword``."""

    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str


# Signatures by license. A line is: label | keyword | pattern of its name | pattern of its identifier.
# The patterns see lower-case words, so "GPL-2.0+" reads "gpl 2 0".
FAMILIES = r"""
apache-1.0 | apache | apache (?:software )?license(?: version)? 1 0 | apache 1 0
apache-1.1 | apache | apache (?:software )?license(?: version)? 1 1 | apache 1 1
apache-2.0 | apache | apache(?: software)? license(?: version)? 2(?: 0)? | apache 2(?: 0)?
mit | mit | mit(?: x11| expat| style)? licen[cs]e | mit
mit-0 | mit | mit no attribution(?: license)? | mit 0
isc | isc | isc licen[cs]e | isc
0bsd | bsd | zero clause bsd(?: license)? | 0bsd
bsd-2-clause | bsd | (?:(?:simplified|2 clause|two clause) bsd|freebsd|bsd 2 clause(?: simplified)?) licen[cs]e | bsd 2 clause
bsd-3-clause | bsd | (?:(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause(?: new or revised| new| revised| modified)?) licen[cs]e | bsd 3 clause
bsd-4-clause | bsd | (?:(?:original|old|4 clause|four clause) bsd|bsd 4 clause(?: original or old| original| old)?) licen[cs]e | bsd 4 clause
gpl-1.0 | general public | (?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?1(?: 0)? | (?:gnu )?gpl ?(?:v|version)? ?1(?: 0)?
gpl-2.0 | general public | (?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)? | (?:gnu )?gpl ?(?:v|version)? ?2(?: 0)?
gpl-3.0 | general public | (?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)? | (?:gnu )?gpl ?(?:v|version)? ?3(?: 0)?
lgpl-2.0 | general public | (?:gnu )?library general public licen[cs]e(?: lgpl)?(?: version| v)? ?2(?: 0)? | (?:gnu )?lgpl ?(?:v|version)? ?2(?: 0)?
lgpl-2.1 | general public | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? ?2 1 | (?:gnu )?lgpl ?(?:v|version)? ?2 1
lgpl-3.0 | general public | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? ?3(?: 0)? | (?:gnu )?lgpl ?(?:v|version)? ?3(?: 0)?
agpl-1.0 | affero | affero general public licen[cs]e(?: version| v)? ?1(?: 0)? | agpl ?(?:v|version)? ?1(?: 0)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e(?: agpl)?(?: version| v)? ?3(?: 0)? | (?:gnu )?agpl ?(?:v|version)? ?3(?: 0)?
gfdl-1.2 | free documentation | gnu free documentation licen[cs]e(?: version| v) ?1 2 | gfdl 1 2
gfdl-1.3 | free documentation | gnu free documentation licen[cs]e(?: version| v) ?1 3 | gfdl 1 3
mpl-1.0 | mozilla | mozilla public licen[cs]e(?: version| v)? ?1 0 | mpl 1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e(?: version| v)? ?1 1 | mpl 1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e(?: version| v)? ?2 0 | mpl 2 0
epl-1.0 | eclipse | eclipse public licen[cs]e(?: version| v)? ?1 0 | epl 1 0
epl-2.0 | eclipse | eclipse public licen[cs]e(?: version| v)? ?2 0 | epl 2 0
edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: version| v)? ?1 0 | edl 1 0
cddl-1.0 | common development | common development and distribution licen[cs]e(?: version| v)? ?1 0 | cddl 1 0
cddl-1.1 | common development | common development and distribution licen[cs]e(?: version| v)? ?1 1 | cddl 1 1
cpl-1.0 | common public | common public licen[cs]e(?: version| v)? ?1 0 | cpl 1 0
eupl-1.1 | european union | european union public licen[cs]e(?: version| v)? ?1 1 | eupl 1 1
eupl-1.2 | european union | european union public licen[cs]e(?: version| v)? ?1 2 | eupl 1 2
artistic-1.0 | artistic | artistic licen[cs]e(?: version| v)? ?1 0 | artistic 1 0
artistic-2.0 | artistic | artistic licen[cs]e(?: version| v)? ?2 0 | artistic 2 0
bsl-1.0 | boost | boost software licen[cs]e(?: version| v)?(?: 1 0)? | bsl 1 0
busl-1.1 | business source | business source licen[cs]e(?: version| v)?(?: 1 1)? | busl 1 1
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
libpng | libpng | libpng licen[cs]e | libpng
unlicense | unlicense | (?:the unlicense|released under the unlicense) | unlicense
wtfpl | want to public | do what the f\w+ you want to public licen[cs]e | wtfpl
ofl-1.1 | open font | (?:sil )?open font licen[cs]e(?: version| v)?(?: 1 1)? | ofl 1 1
ms-pl | microsoft | microsoft public licen[cs]e | ms pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms rl
php-3.01 | php | php licen[cs]e(?: version| v)?(?: 3 01)? | php 3 01
python-2.0 | python | python software foundation licen[cs]e(?: version| v)?(?: 2)? | python 2 0
postgresql | postgresql | postgresql licen[cs]e | postgresql
openssl | openssl | openssl licen[cs]e | openssl
ruby | ruby | ruby licen[cs]e | ruby
vim | vim | vim licen[cs]e | vim
w3c | w3c | w3c software(?: and document)?(?: notice and)? licen[cs]e | w3c
x11 | x11 | x11 licen[cs]e | x11
ncsa | ncsa | university of illinois ncsa open source licen[cs]e | ncsa
curl | curl | curl licen[cs]e | curl
odbl-1.0 | open database | open database licen[cs]e(?: version| v)?(?: 1 0)? | odbl 1 0
odc-by-1.0 | open data commons | open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)? | odc by 1 0
pddl-1.0 | public domain | public domain dedication and licen[cs]e(?: version| v)?(?: 1 0)? | pddl 1 0
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)? | cc0(?: 1 0)?
cc-by-1.0 | creative commons | creative commons attribution 1 0 | cc by 1 0
cc-by-2.0 | creative commons | creative commons attribution 2 0 | cc by 2 0
cc-by-2.5 | creative commons | creative commons attribution 2 5 | cc by 2 5
cc-by-3.0 | creative commons | creative commons attribution 3 0 | cc by 3 0
cc-by-4.0 | creative commons | creative commons attribution 4 0 | cc by 4 0
cc-by-sa-2.0 | creative commons | creative commons attribution share ?alike 2 0 | cc by sa 2 0
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0 | cc by sa 3 0
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0 | cc by sa 4 0
cc-by-nc-2.0 | creative commons | creative commons attribution non ?commercial 2 0 | cc by nc 2 0
cc-by-nc-3.0 | creative commons | creative commons attribution non ?commercial 3 0 | cc by nc 3 0
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0 | cc by nc 4 0
cc-by-nd-3.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s? 3 0 | cc by nd 3 0
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s? 4 0 | cc by nd 4 0
cc-by-nc-sa-3.0 | creative commons | creative commons attribution non ?commercial share ?alike 3 0 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0 | cc by nc sa 4 0
cc-by-nc-nd-3.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s? 3 0 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0 | cc by nc nd 4 0
openrail-m | rail m | (?:bigscience )?open ?rail m licen[cs]e | openrail m
sspl-1.0 | server side | server side public licen[cs]e(?: version| v)?(?: 1)? | sspl 1 0
elastic-2.0 | elastic | elastic licen[cs]e(?: version| v)?(?: 2 0)? | elastic 2 0
"""

# Signatures of their own: label | priority | weight | keyword | pattern.
SINGLE = r"""
gpl | 20 | 0.7 | general public | (?:gnu )?general public licen[cs]e
lgpl | 25 | 0.7 | general public | gnu (?:lesser|library) general public licen[cs]e
agpl | 25 | 0.7 | affero | (?:gnu )?affero general public licen[cs]e
gpl | 15 | 0.5 | gpl | (?:under (?:the )?|licen[cs]e )(?:gnu )?gpl
lgpl | 15 | 0.5 | lgpl | under (?:the )?(?:gnu )?lgpl
agpl | 15 | 0.5 | agpl | under (?:the )?(?:gnu )?agpl
apache | 15 | 0.6 | apache | apache(?: software)? licen[cs]e
mpl | 15 | 0.6 | mozilla | mozilla public licen[cs]e
bsd | 15 | 0.6 | bsd | bsd(?: style)? licen[cs]e
mit | 40 | 0.9 | permission is | permission is hereby granted free of charge to any person obtaining a copy
isc | 40 | 0.9 | permission to | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 35 | 0.8 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 38 | 0.9 | neither the | neither the names? of (?:[^ ]+ ){1,60}?may be used to endorse or promote products
zlib | 40 | 0.9 | provided as is | this software is provided as is without any express or implied warranty in no event
unlicense | 40 | 0.9 | public domain | free and unencumbered software released into the public domain
public-domain | 15 | 0.5 | public domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
gfdl | 20 | 0.7 | free documentation | (?:gnu )?free documentation licen[cs]e
cc | 12 | 0.5 | creative commons | creative commons(?: licen[cs]e| attribution| public licen[cs]e)
cc-by | 14 | 0.6 | cc by | cc by(?: licen[cs]e)?
cc-by-sa | 24 | 0.6 | cc by sa | cc by sa
cc-by-nc | 24 | 0.6 | cc by nc | cc by nc
cc-by-nd | 24 | 0.6 | cc by nd | cc by nd
cc-by-nc-sa | 26 | 0.6 | cc by nc sa | cc by nc sa
cc-by-nc-nd | 26 | 0.6 | cc by nc nd | cc by nc nd
reserved | 20 | 0.6 | all rights | all rights(?: are)? reserved
some-reserved | 20 | 0.5 | rights reserved | some rights reserved
no-reserved | 20 | 0.5 | rights reserved | no rights reserved
proprietary | 18 | 0.6 | proprietary | (?:proprietary and confidential|confidential and proprietary|proprietary licen[cs]e)
eula | 18 | 0.6 | end user | end user licen[cs]e agreement
apache | 36 | 0.9 | you may not | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache | 36 | 0.8 | as is basis | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache | 34 | 0.8 | grant of | grant of (?:copyright|patent) license subject to the terms and conditions of this license each contributor hereby grants
mit | 38 | 0.9 | above copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 36 | 0.8 | as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 | 42 | 0.9 | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
bsd | 34 | 0.8 | retain the | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 34 | 0.8 | binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | 33 | 0.7 | copyright holders | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd-4-clause | 39 | 0.9 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | 38 | 0.9 | disclaims all | the (?:software|author) (?:is provided as is and the author )?disclaims all warranties with regard to this software
0bsd | 41 | 0.8 | with or without fee | distribute this software for any purpose with or without fee is hereby granted the software is provided
gpl | 32 | 0.9 | free software | this program is free software(?: you can|:)? redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | 31 | 0.8 | free software | this program is free software you can redistribute it
gpl | 30 | 0.8 | received a copy | you should have received a copy of the gnu general public licen[cs]e along with this (?:program|file|software)
gpl | 28 | 0.7 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e
lgpl | 33 | 0.9 | free software | this library is free software you can redistribute it
lgpl | 33 | 0.9 | received a copy | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this library
agpl | 33 | 0.9 | received a copy | you should have received a copy of the gnu affero general public licen[cs]e
agpl | 32 | 0.8 | remotely | users interacting with it remotely through a computer network
gpl-3.0 | 37 | 0.9 | circumvention | protecting users legal rights from anti circumvention law
gpl | 22 | 0.6 | copyleft | strong copyleft licen[cs]e
lgpl | 22 | 0.5 | copyleft | weak copyleft licen[cs]e
mpl-2.0 | 38 | 0.9 | source code form | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 | 38 | 0.9 | contents of this file | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl | 30 | 0.7 | the mpl | if a copy of the mpl was not distributed with this file
epl-1.0 | 37 | 0.9 | accompanying | the accompanying program is provided under the terms of this eclipse public licen[cs]e agreement
epl-2.0 | 37 | 0.9 | this program and | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e(?: v| version)? 2 0
cddl-1.0 | 36 | 0.8 | the contents of | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
artistic-2.0 | 34 | 0.8 | verbatim copies | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which
artistic-1.0 | 34 | 0.8 | artistic control | the copyright holder maintains some semblance of artistic control over the development of the package
perl | 24 | 0.7 | terms as perl | under the same terms as perl(?: 5)? itself
ruby | 24 | 0.6 | ruby | under the same terms as ruby
python-2.0 | 34 | 0.8 | psf is | psf is making python available to licensee on an as is basis
bsl-1.0 | 38 | 0.9 | accompanying documentation | obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software
busl-1.1 | 34 | 0.8 | change date | effective on the change date or the fourth anniversary of the first publicly available distribution
zlib | 38 | 0.9 | must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | 36 | 0.8 | contributing authors | the contributing authors and group 42 inc disclaim all warranties
openssl | 36 | 0.8 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 34 | 0.7 | eric young | this product includes cryptographic software written by eric young
wtfpl | 36 | 0.9 | you just do | you just do what the f\w+ you want to
ofl-1.1 | 36 | 0.9 | reserved font | (?:with )?reserved font names?
ofl-1.1 | 35 | 0.8 | sold by itself | neither the font software nor any of its individual components in original or modified versions may be sold by itself
w3c | 34 | 0.8 | by obtaining | by obtaining (?:using and or copying )?this work you the licensee agree that you have read understood and will comply
ncsa | 36 | 0.8 | deal with the software | to deal with the software without restriction
postgresql | 36 | 0.8 | without a written | without fee and without a written agreement is hereby granted
curl | 34 | 0.8 | hereby granted | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
x11 | 36 | 0.8 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
hpnd | 30 | 0.7 | supporting documentation | that both that copyright notice and this permission notice appear in supporting documentation
cc0-1.0 | 36 | 0.9 | waived all | (?:has )?waived all copyright and related or neighboring rights
cc-by | 26 | 0.7 | give appropriate | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | 27 | 0.7 | same license | you must distribute your contributions under the same license as the original
cc-by-nc | 27 | 0.7 | commercial purposes | you may not use the material for commercial purposes
cc-by-nd | 27 | 0.7 | modified material | you may not distribute the modified material
cc-by | 28 | 0.7 | creativecommons | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa | 29 | 0.8 | creativecommons | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc | 29 | 0.8 | creativecommons | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 29 | 0.8 | creativecommons | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa | 30 | 0.8 | creativecommons | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 30 | 0.8 | creativecommons | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc0-1.0 | 30 | 0.8 | creativecommons | creativecommons org publicdomain zero 1 0
apache-2.0 | 30 | 0.8 | apache org | apache org licenses license 2 0
gpl | 18 | 0.6 | gnu org | gnu org (?:licenses|copyleft) (?:gpl|old licenses gpl)
lgpl | 19 | 0.6 | gnu org | gnu org (?:licenses|copyleft) lesser
mit | 22 | 0.6 | opensource org | opensource org licenses? mit(?: license(?: php)?)?
unlicense | 30 | 0.8 | unlicense org | unlicense org
odbl-1.0 | 24 | 0.7 | odbl | odbl
sspl-1.0 | 30 | 0.8 | as a service | offering the program as a service
elastic-2.0 | 30 | 0.8 | managed service | you may not provide the software to third parties as a hosted or managed service
openrail-m | 26 | 0.7 | use based | use based restrictions as referenced in paragraph
llama | 30 | 0.8 | community license | llama [0-9](?: [0-9])? community license agreement
gemma | 30 | 0.8 | gemma | gemma terms of use
cecill | 30 | 0.8 | cecill | (?:cecill(?: free software)? licen[cs]e|contrat de licence de logiciel libre cecill)
jquery | 18 | 0.5 | dual licensed | dual licensed under the mit (?:and|or) gpl(?: version 2)? licen[cs]es?
beerware | 34 | 0.8 | this stuff | as long as you retain this notice you can do whatever you want with this stuff
json | 34 | 0.8 | for good | the software shall be used for good not evil
oracle | 24 | 0.6 | oracle | oracle (?:technology network|binary code) licen[cs]e agreement
adobe | 24 | 0.6 | adobe | adobe systems incorporated grants to you
shareware | 16 | 0.5 | shareware | this is shareware
freeware | 16 | 0.5 | freeware | (?:this is|released as|distributed as) freeware
confidential | 20 | 0.6 | confidential | this document contains (?:proprietary and )?confidential information
proprietary | 22 | 0.6 | unauthorized | unauthorized (?:copying|reproduction)
proprietary | 22 | 0.6 | no part of | no part of this (?:publication|work|book) may be reproduced
proprietary | 21 | 0.6 | prior written | without the prior written permission of the (?:publisher|author|copyright (?:owner|holder))
crown | 24 | 0.6 | crown copyright | crown copyright
open-government | 26 | 0.7 | open government | open government licen[cs]e(?: v| version)?(?: [1-3] 0)?
gnu-all-permissive | 34 | 0.8 | any medium | copying and distribution of this file with or without modification are permitted in any medium without royalty
copyright | 5 | 0.3 | copyright | copyright(?: c)? (?:19|20)[0-9]{2}
"""


#: Licenses whose identifier with its version is a plain phrase too ("EPL 1 0" is also a score), so it must come after a verb.
UNSURE = ("epl", "edl", "cpl", "php", "python", "elastic")


@functools.cache
def rules() -> tuple[tuple[Rule, re.Pattern], ...]:
    """All signatures in order: for each license of FAMILIES its name and identifier, alone and in the phrases that introduce them, and those of SINGLE."""
    found = []
    for line in FAMILIES.strip().splitlines():
        label, keyword, name, ident = (x.strip() for x in line.split(" | "))
        first = re.sub(r"^\(\?:[^)]*\)\?", "", ident).split("(")[0].removesuffix("?").strip()
        found += [
            Rule(label, 60, 0.95, "spdx", rf"spdx license identifier {ident}(?: only| or later)?"),
            Rule(label, 50, 0.9, keyword, rf"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?{name}(?: only| or later| or any later version)?"),
            Rule(label, 45, 0.8, keyword, name),
            Rule(label, 30, 0.7, first, rf"(?:licen[cs]e[ds]?|released|available|distributed|published)(?: is| under)?(?: the)? {ident}(?: licen[cs]e)?"),
        ]
        if re.search(r"[0-9]", label) and label.split("-")[0] not in UNSURE:
            found.append(Rule(label, 28, 0.6, first, rf"{ident}(?: only| or later)?"))
    for line in SINGLE.strip().splitlines():
        label, priority, weight, keyword, pattern = (x.strip() for x in line.split(" | "))
        found.append(Rule(label, int(priority), float(weight), keyword, pattern))
    return tuple((r, re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])")) for r in found)


@functools.cache
def _by_keyword() -> dict[str, list[tuple[Rule, re.Pattern]]]:
    out: dict[str, list] = {}
    for rule in rules():
        out.setdefault(rule[0].keyword, []).append(rule)
    return out


def words_of(text: str) -> bytes:
    """The words of a text, joined by single spaces."""
    return b" ".join(text.encode().translate(WORD_BYTES).split())


def places(joined: bytes, phrase: bytes) -> list[int]:
    """The word numbers at which the words of ``phrase`` stand one after the other."""
    out, at, number, last = [], 0, 0, 0
    padded, wanted = b" " + joined + b" ", b" " + phrase + b" "
    while (at := padded.find(wanted, at)) >= 0:
        number += padded.count(b" ", last, at)
        out.append(number)
        last, at = at, at + 1
    return out


def detect(joined: str) -> list[tuple[int, int, Rule]]:
    """Detections that stand, as (start, end, rule) in characters: in order of priority, then length, then place, each is
    dropped that lies within one already kept."""
    found = []
    for keyword, group in _by_keyword().items():
        if keyword in joined:
            found += [(m.start(), m.end(), rule) for rule, pattern in group for m in pattern.finditer(joined)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    kept: list[tuple[int, int, Rule]] = []
    at: dict[int, list[tuple[int, int]]] = {}  # spans kept, by the stretch of text in which they start
    stretch = max((d[1] - d[0] for d in found), default=1)  # one that holds d starts in d's stretch or the one before
    for d in found:
        k = d[0] // stretch
        if not any(a <= d[0] and d[1] <= b for a, b in [*at.get(k, ()), *at.get(k - 1, ())]):
            kept.append(d)
            at.setdefault(k, []).append(d[:2])
    return kept


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are the smallest and largest word
    number at which one starts (null if none). ``labels`` joins the base labels with those of the detections that stand;
    ``score`` is 1 minus the product of what their weights leave. A null text is empty: no words, no labels, score 0. Texts are
    scanned whole, however long. Columns of these names in ``df`` are replaced, in any case. Repeated rows each get the same result; an empty
    table gives an empty one.
    """

    def one(value: str) -> tuple:
        joined = words_of(value)
        at = [(n, label) for phrase, label in BASE for n in places(joined, phrase.encode())]
        kept = detect(joined.decode())
        base, left = {label for _, label in at}, 1.0
        for rule in {k[2] for k in kept}:
            left *= 1 - rule.weight
        if base and left == 1.0:
            left = 0.5
        starts = [n for n, _ in at]
        labels = sorted(base | {k[2].label for k in kept})
        return (
            joined.count(b" ") + 1 if joined else 0, len(at), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(labels), round(1 - left, 6),
        )

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = [one(t) for t in texts(batch, text)]
        return {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))}

    return with_columns(df, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", run)
