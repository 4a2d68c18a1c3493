"""The license scan's rules, in order: a later rule gives way to an earlier one on the same words.

Patterns are regular expressions over the words of a text (letters, digits and
signs beyond ASCII, lower-cased, one blank between two words), from a word's
start to a word's end; ``~3`` stands for up to three words of any kind.  Every
rule names words that each of its matches holds: the prefilter.

Levels: 4 base phrases, 3 grants, identifiers, addresses and sentences of a
license's own text, 2 a license's name, 1 a mention that may mean several.
"""

from __future__ import annotations

import re
from typing import NamedTuple

BASE, EXACT, NAME, MENTION = 4, 3, 2, 1


class Rule(NamedTuple):
    number: int
    label: str
    level: int
    words: tuple[str, ...]
    pattern: str


#: Fixed phrases and labels of the base.
BASE_PHRASES = """
mit | license | under the mit license
apache-2 | apache | apache license version 2
cc-by-nc | cc | cc by nc
"""

#: label | words every match holds | the license's name | its identifier as words.
NAMES = """
mit | mit | mit (?:expat )?licen[cs]e | mit
mit-0 | mit attribution | mit no attribution(?: licen[cs]e)? | mit 0
x11 | x11 | x11 licen[cs]e | x11
expat | expat | expat licen[cs]e | mit
apache-1 | apache | apache(?: software)? licen[cs]e (?:version )?v?1(?: [01])? | apache 1 [01]
apache-2 | apache | apache(?: software)?(?: licen[cs]e)? (?:version )?v?2(?: 0)? | apache 2 0
bsd-1 | bsd 1 clause | (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)? | bsd 1 clause
bsd-2 | bsd 2 clause | (?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)? | bsd 2 clause
bsd-3 | bsd 3 clause | (?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)? | bsd 3 clause
bsd-4 | bsd 4 clause | (?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)? | bsd 4 clause
bsd-0 | zero clause bsd | (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)? | 0bsd
bsd-0 | 0bsd | 0bsd licen[cs]e | 0bsd
bsd-2 | simplified bsd | simplified bsd licen[cs]e | bsd 2 clause
bsd-2 | freebsd | freebsd licen[cs]e | bsd 2 clause
bsd-3 | revised bsd | revised bsd licen[cs]e | bsd 3 clause
bsd-3 | new bsd | new bsd licen[cs]e | bsd 3 clause
gpl-1 | gnu general public | gnu general public licen[cs]e (?:version )?v?1(?: 0)? | gpl 1 0(?: (?:only|or later))?
gpl-2 | gnu general public | gnu general public licen[cs]e (?:version )?v?2(?: 0)? | gpl 2 0(?: (?:only|or later))?
gpl-3 | gnu general public | gnu general public licen[cs]e (?:version )?v?3(?: 0)? | gpl 3 0(?: (?:only|or later))?
gpl-2 | gplv2 | (?:gnu )?gplv2 | gplv2
gpl-3 | gplv3 | (?:gnu )?gplv3 | gplv3
gpl-2 | gpl 2 | (?:gnu )?gpl (?:version )?2(?: 0)? | gpl 2 0
gpl-3 | gpl 3 | (?:gnu )?gpl (?:version )?3(?: 0)? | gpl 3 0
lgpl-2 | gnu library general public | gnu library general public licen[cs]e(?: (?:version )?v?2(?: 0)?)? | lgpl 2 0(?: (?:only|or later))?
lgpl-2.1 | gnu lesser general public 1 | gnu lesser general public licen[cs]e (?:version )?v?2 1 | lgpl 2 1(?: (?:only|or later))?
lgpl-3 | gnu lesser general public | gnu lesser general public licen[cs]e (?:version )?v?3(?: 0)? | lgpl 3 0(?: (?:only|or later))?
lgpl-2.1 | lgpl 1 | (?:gnu )?lgpl (?:version )?v?2 1 | lgpl 2 1
lgpl-3 | lgplv3 | (?:gnu )?lgplv3 | lgplv3
agpl-1 | affero general public | affero general public licen[cs]e (?:version )?v?1(?: 0)? | agpl 1 0(?: (?:only|or later))?
agpl-3 | affero general public | (?:gnu )?affero general public licen[cs]e(?: (?:version )?v?3(?: 0)?)? | agpl 3 0(?: (?:only|or later))?
agpl-3 | agplv3 | (?:gnu )?agplv3 | agplv3
gfdl-1.3 | gnu free documentation | gnu free documentation licen[cs]e(?: (?:version )?v?1 [123])? | gfdl 1 [123](?: (?:only|or later))?
mpl-1 | mozilla public | mozilla public licen[cs]e (?:version )?v?1(?: [01])? | mpl 1 [01]
mpl-2 | mozilla public | mozilla public licen[cs]e (?:version )?v?2(?: 0)? | mpl 2 0
epl-1 | eclipse public | eclipse public licen[cs]e (?:version )?v?1(?: 0)? | epl 1 0
epl-2 | eclipse public | eclipse public licen[cs]e (?:version )?v?2(?: 0)? | epl 2 0
edl-1 | eclipse distribution | eclipse distribution licen[cs]e(?: (?:version )?v?1(?: 0)?)? | bsd 3 clause
cddl-1 | common development and distribution | common development and distribution licen[cs]e(?: (?:version )?v?1(?: [01])?)? | cddl 1 [01]
cpl-1 | common public | common public licen[cs]e(?: (?:version )?v?1(?: 0)?)? | cpl 1 0
eupl-1 | european union public | european union public licen[cs]e(?: (?:version )?v?1(?: [012])?)? | eupl 1 [012]
isc | isc | isc licen[cs]e | isc
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
libpng | libpng | (?:the )?libpng licen[cs]e | libpng(?: 2 0)?
boost-1 | boost | boost software licen[cs]e(?: (?:version )?v?1(?: 0)?)? | bsl 1 0
unlicense | unlicense | the unlicense | unlicense
wtfpl | do what the want | do what the f[^ ]* you want to public licen[cs]e | wtfpl
artistic-1 | artistic | artistic licen[cs]e (?:version )?v?1(?: 0)? | artistic 1 0
artistic-2 | artistic | artistic licen[cs]e (?:version )?v?2(?: 0)? | artistic 2 0
psf-2 | python software foundation | python software foundation licen[cs]e(?: (?:version )?v?2(?: 0)?)? | psf 2 0
python-2 | python | python licen[cs]e (?:version )?v?2(?: 0)? | python 2 0(?: 1)?
postgresql | postgresql | postgresql licen[cs]e | postgresql
ruby | ruby | ruby licen[cs]e | ruby
php-3 | php | php licen[cs]e (?:version )?v?3(?: 0[01]?)? | php 3 0[01]?
openssl | openssl | openssl licen[cs]e | openssl
curl | curl | curl licen[cs]e | curl
ofl-1.1 | open font | (?:sil )?open font licen[cs]e(?: (?:version )?v?1(?: [01])?)? | ofl 1 1
ms-pl | microsoft public | microsoft public licen[cs]e | ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | ms rl
afl-3 | academic free | academic free licen[cs]e(?: (?:version )?v?[123](?: [01])?)? | afl 3 0
osl-3 | open software | open software licen[cs]e(?: (?:version )?v?[123](?: [01])?)? | osl 3 0
ncsa | illinois ncsa | (?:university of )?illinois ncsa open source licen[cs]e | ncsa
upl-1 | universal permissive | universal permissive licen[cs]e(?: (?:version )?v?1(?: 0)?)? | upl 1 0
bsl-1.1 | business source | business source licen[cs]e(?: (?:version )?v?1(?: 1)?)? | busl 1 1
sspl-1 | server side public | server side public licen[cs]e(?: (?:version )?v?1)? | sspl 1 0
elastic-2 | elastic | elastic licen[cs]e(?: (?:version )?v?2(?: 0)?)? | elastic 2 0
mulan-2 | mulan | mulan (?:psl|permissive software licen[cs]e) (?:version )?v?2 | mulanpsl 2 0
cecill-2 | cecill | cecill(?: free software)? licen[cs]e(?: agreement)? | cecill 2 [01]
odbl-1 | open database | open database licen[cs]e(?: (?:version )?v?1(?: 0)?)? | odbl 1 0
odc-by-1 | open data commons attribution | open data commons attribution licen[cs]e(?: (?:version )?v?1(?: 0)?)? | odc by 1 0
pddl-1 | public domain dedication | (?:open data commons )?public domain dedication and licen[cs]e | pddl 1 0
openrail | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)? | openrail
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0
cc-by | creative commons attribution | creative commons attribution(?: [1234] [05])?(?: (?:international|unported|generic))?(?: public)? licen[cs]e | cc by [1234] [05]
cc-by-sa | attribution sharealike | (?:creative commons )?attribution sharealike(?: [1234] [05])?(?: (?:international|unported|generic))? | cc by sa [1234] [05]
cc-by-sa | attribution share alike | (?:creative commons )?attribution share alike(?: [1234] [05])?(?: (?:international|unported|generic))? | cc by sa [1234] [05]
cc-by-nd | attribution noderivatives | (?:creative commons )?attribution noderivatives(?: [1234] [05])?(?: (?:international|unported|generic))? | cc by nd [1234] [05]
cc-by-nc | attribution noncommercial | (?:creative commons )?attribution noncommercial(?: [1234] [05])?(?: (?:international|unported|generic))? | cc by nc [1234] [05]
cc-by-nc-sa | attribution noncommercial sharealike | (?:creative commons )?attribution noncommercial sharealike(?: [1234] [05])?(?: (?:international|unported|generic))? | cc by nc sa [1234] [05]
cc-by-nc-nd | attribution noncommercial noderivatives | (?:creative commons )?attribution noncommercial noderivatives(?: [1234] [05])?(?: (?:international|unported|generic))? | cc by nc nd [1234] [05]
"""

#: label | words | sentence of the license's own text, or of the notice it asks for.
SENTENCES = """
mit | hereby granted obtaining copy | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | copyright permission notice substantial | the above copyright notice and this permission notice ~3 shall be included in all copies or substantial portions
x11 | except as contained notice advertising | except as contained in this notice the names? of ~8 shall not be used in advertising
json | shall good evil | the software shall be used for good not evil
isc | permission copy modify fee hereby | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
postgresql | permission copy modify documentation fee | permission to use copy modify and distribute this software and its documentation for any purpose without fee
bsd | redistribution source binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | neither nor endorse promote | neither the names? of ~12 nor the names of ~3 contributors may be used to endorse or promote
bsd-4 | advertising materials mentioning features | all advertising materials mentioning features or use of this software must display
bsd-2 | freebsd views conclusions | the views and conclusions contained in the software ~10 freebsd project
apache-2 | file except compliance | you may not use this file except in compliance with the license
apache-2 | unless required applicable writing | unless required by applicable law or agreed to in writing software distributed under the license
apache-2 | perpetual worldwide irrevocable reproduce | a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
apache-1 | developed apache foundation | this product includes software developed by the apache software foundation
gpl-2 | either version 2 later | either version 2 of the license or at your option any later version
gpl-3 | either version 3 later | either version 3 of the license or at your option any later version
gpl | redistribute modify gnu general | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | redistribute modify gnu lesser | you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl-3 | redistribute modify gnu affero | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl | program hope useful warranty | this program is distributed in the hope that it will be useful but without any warranty
lgpl | library hope useful | this library is distributed in the hope that it will be useful but without any warranty
gfdl-1.3 | copy distribute modify gnu documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | source form subject mozilla | this source code form is subject to the terms of the mozilla public license
mpl-1 | contents subject mozilla | the contents of this file are subject to the mozilla public license
epl | accompanying materials eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1 | contents subject common development | the contents of this file are subject to the terms of the common development and distribution license
zlib | provided express implied liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | altered source versions marked | altered source versions must be plainly marked as such and must not be misrepresented
boost-1 | hereby organization obtaining accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | free unencumbered public domain | this is free and unencumbered software released into the public domain
cc0-1 | waived copyright neighboring | has waived all copyright and related or neighboring rights
cc0-1 | dedicated public domain waiving | has dedicated the work to the public domain by waiving
wtfpl | just do what want | you just do what the f[^ ]* you want to
beerware | retain notice whatever stuff | as long as you retain this notice you can do whatever you want with this stuff
artistic-2 | package distributed artistic | this package is ~6 distributed under the artistic license
perl | same terms perl itself | (?:under|on) the same terms as perl itself
ruby | same terms ruby itself | (?:under|on) the same terms as ruby itself
psf-2 | psf making python licensee | psf is making python available to licensee
openssl | developed openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ofl-1.1 | font software licensed sil | this font software is licensed under the sil open font license
eupl-1 | licensed eupl | licensed under the eupl
ms-pl | contributor grants worldwide reproduce | each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution
elastic-2 | provide hosted managed service | you may not provide the software to third parties as a hosted or managed service
bsl-1.1 | licensor copy modify production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
sspl-1 | functionality third parties service | if you make the functionality of the program or a modified version available to third parties as a service
odbl-1 | made available open database | is made available under the open database license
cc-by | free share adapt appropriate credit | you are free to share ~6 adapt ~20 you must give appropriate credit
all-rights-reserved | all rights reserved | all rights reserved
proprietary | proprietary confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized copying prohibited | unauthorized copying of this file ~8 is strictly prohibited
non-commercial | non commercial use only | for (?:personal |research )?(?:and )?non commercial use only
non-commercial | noncommercial use only | for (?:personal |research )?(?:and )?noncommercial use only
public-domain | public domain | (?:is|are|placed|released) in(?:to)? the public domain
"""

#: label | words | web address, as words.
ADDRESSES = """
mit | opensource mit | opensource org licenses? mit
apache-2 | apache licenses 2 | apache org licenses license 2 0
bsd-2 | opensource bsd 2 | opensource org licenses? bsd 2 clause
bsd-3 | opensource bsd 3 | opensource org licenses? bsd 3 clause
isc | opensource isc | opensource org licenses? isc
gpl-2 | gnu licenses gpl 2 | gnu org licenses ~2 gpl 2 0
gpl-3 | gnu licenses gpl 3 | gnu org licenses gpl 3 0
gpl | gnu licenses gpl | gnu org licenses gpl html
lgpl-2.1 | gnu licenses lgpl 2 | gnu org licenses ~2 lgpl 2 1
lgpl-3 | gnu licenses lgpl 3 | gnu org licenses lgpl 3 0
agpl-3 | gnu licenses agpl 3 | gnu org licenses agpl 3 0
gfdl-1.3 | gnu licenses fdl | gnu org licenses fdl 1 [123]
mpl-2 | mozilla mpl 2 | mozilla org ~1 mpl 2 0
epl-1 | eclipse legal epl | eclipse org legal epl v10
epl-2 | eclipse legal epl | eclipse org legal epl (?:2 0|v20)
boost-1 | boost org license | boost org license 1 0
unlicense | unlicense org | unlicense org
ofl-1.1 | scripts sil ofl | scripts sil org ofl
cc-by | creativecommons licenses by | creativecommons org licenses by [1234] [05]
cc-by-sa | creativecommons licenses sa | creativecommons org licenses by sa [1234] [05]
cc-by-nd | creativecommons licenses nd | creativecommons org licenses by nd [1234] [05]
cc-by-nc | creativecommons licenses nc | creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa | creativecommons licenses nc sa | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | creativecommons licenses nc nd | creativecommons org licenses by nc nd [1234] [05]
cc0-1 | creativecommons publicdomain zero | creativecommons org publicdomain zero 1 0
"""

#: label | words | mention that leaves the version or the variant open; and short forms.
MENTIONS = """
gpl | gnu general public | gnu general public licen[cs]e
gpl | gpl | (?:gnu )?gpl licen[cs]ed?
lgpl | gnu lesser general public | gnu lesser general public licen[cs]e
lgpl | lgpl | (?:gnu )?lgpl licen[cs]ed?
mpl | mozilla public | mozilla public licen[cs]e
epl | eclipse public | eclipse public licen[cs]e
apache | apache | apache(?: software)? licen[cs]e
apache | apache | apache licen[cs]ed
bsd | bsd | bsd(?: style)? licen[cs]ed?
artistic | artistic | artistic licen[cs]e
creative-commons | creative commons | creative commons(?: public)? licen[cs]e
mit | mit | mit licen[cs]ed
cc-by-nc-sa | cc nc sa | cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc nc nd | cc by nc nd(?: [1234] [05])?
cc-by-sa | cc sa | cc by sa(?: [1234] [05])?
cc-by-nd | cc nd | cc by nd(?: [1234] [05])?
cc-by-nc | cc nc | cc by nc [1234] [05]
cc-by | cc by | cc by [1234] [05]
"""

GRANT = "(?:licen[cs]ed|released|distributed|redistributed|published|provided|available|issued|shared) under (?:the )?(?:terms of )?(?:the )?"


def _lines(text: str) -> list[list[str]]:
    return [[f.strip() for f in line.split(" | ")] for line in text.strip().splitlines()]


def compiled(pattern: str) -> str:
    """The pattern over `` word  word `` (a blank before and after every word)."""
    spread = re.sub(r"~(\d+) ", r"(?:[^ ]+ ){0,\1}", pattern)
    return " (?:" + spread.replace("[^ ]", "\0").replace(" ", "  ").replace("\0", "[^ ]") + ") "


def rules() -> list[Rule]:
    """All rules in order: base phrases, grants, identifiers, sentences, addresses, names, mentions."""
    out: dict[tuple[str, str], tuple[int, tuple[str, ...]]] = {}

    def add(label: str, level: int, words: str, pattern: str) -> None:
        out.setdefault((label, pattern), (level, tuple(words.split())))

    for label, words, phrase in _lines(BASE_PHRASES):
        add(label, BASE, words, phrase)
    names = _lines(NAMES)
    for label, words, name, _ in names:
        add(label, EXACT, words + " under", f"{GRANT}(?:{name})")
    for label, _, _, spdx in names:
        add(label, EXACT, f"spdx {re.match("[a-z0-9]+", spdx)[0]}", f"spdx license identifier (?:{spdx})")
    for label, words, pattern in _lines(SENTENCES) + _lines(ADDRESSES):
        add(label, EXACT, words, pattern)
    for label, words, name, _ in names:
        add(label, NAME, words, name)
    for label, words, pattern in _lines(MENTIONS):
        add(label, MENTION, words, pattern)
    return [Rule(i, label, level, words, compiled(pattern)) for i, ((label, pattern), (level, words)) in enumerate(out.items())]
