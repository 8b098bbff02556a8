"""Signature rules for licences: hand-written expressions over lower-case words joined by single spaces.

Every rule names words that each of its matches holds ("a|b c": a or b, and c); the first of them is its anchor. A match
never has more than SPAN words, so the words around an anchor are all that a rule has to see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPAN = 48


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: str
    needs: str
    base: bool = False  # detections that no other rule suppresses
    words: tuple[frozenset[str], ...] = field(init=False, compare=False)
    expression: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "words", tuple(frozenset(x.split("|")) for x in self.needs.split()))
        object.__setattr__(self, "expression", re.compile(rf"(?<![^ ])(?:{self.pattern})(?![^ ])"))

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def confidence(self) -> float:
        return KINDS[self.kind][1]


#: Kind: priority (smaller ones win) and confidence.
KINDS = {"identifier": (0, 0.99), "text": (1, 0.97), "grant": (1, 0.95), "field": (2, 0.9), "phrase": (3, 0.9), "title": (3, 0.8), "hint": (4, 0.4)}

#: (label, title, short identifier, words that both need). "@2 0" stands for a version that may be written several ways.
NAMES = [
    ("mit", "(?:mit|expat)(?: x11)?(?: style)? licen[sc]e", "mit", "mit|expat"),
    ("mit-0", "mit no attribution(?: licen[sc]e)?", "mit 0", "mit"),
    ("x11", "x11 licen[sc]e", "x11", "x11"),
    ("apache-1", "apache(?: software)? licen[sc]e @1 [01]", "apache 1 [01]", "apache"),
    ("apache-2", "apache(?: software)?(?: foundation)? licen[sc]e @2 0", "apache 2 0", "apache"),
    ("apache", "apache(?: software)? licen[sc]e", "apache", "apache"),
    ("gpl-1", "(?:gnu )?(?:general public licen[sc]e|gpl) @1(?: 0)?(?: or(?: any)? later)?", "gpl 1 0(?: only| or later)?", "gnu|gpl|general"),
    ("gpl-2", "(?:gnu )?(?:general public licen[sc]e|gpl) @2 0(?: or(?: any)? later)?", "gpl 2 0(?: only| or later)?", "gnu|gpl|general"),
    ("gpl-3", "(?:gnu )?(?:general public licen[sc]e|gpl) @3 0(?: or(?: any)? later)?", "gpl 3 0(?: only| or later)?", "gnu|gpl|general"),
    ("gpl-2", "gplv2(?: or later)?", "gplv2", "gplv2"),
    ("gpl-3", "gplv3(?: or later)?", "gplv3", "gplv3"),
    ("gpl", "(?:gnu general public licen[sc]e|gnu gpl)", "gpl", "gnu|gpl"),
    ("lgpl-2", "gnu library general public licen[sc]e(?: @2 0)?", "lgpl 2 0(?: only| or later)?", "gnu|lgpl"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl) @2 1(?: or(?: any)? later)?", "lgpl 2 1(?: only| or later)?", "lesser|lgpl"),
    ("lgpl-3", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl) @3 0(?: or(?: any)? later)?", "lgpl 3 0(?: only| or later)?", "lesser|lgpl"),
    ("lgpl", "(?:gnu lesser general public licen[sc]e|gnu lgpl)", "lgpl", "lesser|lgpl"),
    ("agpl-3", "(?:gnu )?(?:affero general public licen[sc]e|agpl) @3 0(?: or(?: any)? later)?", "agpl 3 0(?: only| or later)?", "affero|agpl"),
    ("agpl-3", "agplv3(?: or later)?", "agplv3", "agplv3"),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "agpl", "affero|agpl"),
    ("gfdl", "gnu free documentation licen[sc]e(?: @1 [123])?", "gfdl 1 [123](?: only| or later)?", "gnu|gfdl"),
    ("bsd-0", "(?:bsd zero clause|zero clause bsd|0 clause bsd)(?: licen[sc]e)?", "0bsd", "bsd|0bsd"),
    ("bsd-1", "(?:1|one) clause bsd(?: licen[sc]e)?|bsd (?:1|one) clause(?: licen[sc]e)?", "bsd 1 clause", "bsd clause"),
    ("bsd-2", "(?:(?:2|two) clause|simplified|freebsd) bsd(?: licen[sc]e)?|bsd (?:2|two) clause(?: licen[sc]e)?", "bsd 2 clause", "bsd"),
    ("bsd-3", "(?:(?:3|three) clause|new|modified|revised) bsd(?: licen[sc]e)?|bsd (?:3|three) clause(?: licen[sc]e)?", "bsd 3 clause(?: clear)?", "bsd"),
    ("bsd-4", "(?:(?:4|four) clause|original) bsd(?: licen[sc]e)?|bsd (?:4|four) clause(?: licen[sc]e)?", "bsd 4 clause", "bsd"),
    ("bsd", "bsd(?: style| like)? licen[sc]e", "bsd", "bsd"),
    ("isc", "isc licen[sc]e", "isc", "isc"),
    ("mpl-1.1", "(?:mozilla public licen[sc]e|mpl) @1 1", "mpl 1 1", "mozilla|mpl"),
    ("mpl-2", "(?:mozilla public licen[sc]e|mpl) @2 0", "mpl 2 0", "mozilla|mpl"),
    ("mpl", "mozilla public licen[sc]e", "mpl", "mozilla|mpl"),
    ("epl-1", "(?:eclipse public licen[sc]e|epl) @1 0", "epl 1 0", "eclipse|epl"),
    ("epl-2", "(?:eclipse public licen[sc]e|epl) @2 0", "epl 2 0", "eclipse|epl"),
    ("epl", "eclipse public licen[sc]e", "epl", "eclipse|epl"),
    ("edl-1", "eclipse distribution licen[sc]e(?: @1 0)?", "edl 1 0", "eclipse|edl"),
    ("cddl-1", "(?:common development and distribution licen[sc]e|cddl)(?: @1 [01])?", "cddl 1 [01]", "development|cddl"),
    ("cpl-1", "common public licen[sc]e(?: @1 0)?", "cpl 1 0", "common|cpl"),
    ("cpal-1", "common public attribution licen[sc]e(?: @1 0)?", "cpal 1 0", "attribution|cpal"),
    ("ipl-1", "ibm public licen[sc]e(?: @1 0)?", "ipl 1 0", "ibm|ipl"),
    ("bsl-1", "boost software licen[sc]e(?: @1 0)?", "bsl 1 0", "boost|bsl"),
    ("busl-1.1", "business source licen[sc]e(?: @1 1)?", "busl 1 1", "business|busl"),
    ("sspl-1", "server side public licen[sc]e(?: @1 0?)?", "sspl 1 0", "server|sspl"),
    ("elastic-2", "elastic licen[sc]e(?: @2 0)?", "elastic 2 0", "elastic"),
    ("artistic-1", "artistic licen[sc]e @1 0", "artistic 1 0(?: perl)?", "artistic"),
    ("artistic-2", "artistic licen[sc]e @2 0", "artistic 2 0", "artistic"),
    ("artistic", "artistic licen[sc]e", "artistic", "artistic"),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "wtfpl", "fuck|wtfpl"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", "zlib"),
    ("libpng", "(?:libpng|png reference library) licen[sc]e(?: @2)?", "libpng 2 0", "libpng|png"),
    ("curl", "curl licen[sc]e", "curl", "curl"),
    ("openssl", "openssl licen[sc]e", "openssl", "openssl"),
    ("php-3", "php licen[sc]e(?: @3 0?1?)?", "php 3 01?", "php"),
    ("python-2", "(?:python software foundation|psf) licen[sc]e(?: agreement)?(?: @2)?", "(?:psf|python) 2 0", "python|psf"),
    ("ruby", "ruby licen[sc]e", "ruby", "ruby"),
    ("w3c", "w3c software(?: notice)?(?: and)? licen[sc]e", "w3c", "w3c"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", "ncsa", "ncsa"),
    ("postgresql", "postgresql licen[sc]e", "postgresql", "postgresql"),
    ("unicode", "unicode licen[sc]e(?: agreement| v3)?", "unicode(?: dfs)?(?: 3 0| 2016)?", "unicode"),
    ("icu", "icu licen[sc]e", "icu", "icu"),
    ("vim", "vim licen[sc]e", "vim", "vim"),
    ("sleepycat", "sleepycat licen[sc]e", "sleepycat", "sleepycat"),
    ("blueoak-1", "blue oak model licen[sc]e(?: @1 0 0)?", "blueoak 1 0 0", "oak|blueoak"),
    ("upl-1", "universal permissive licen[sc]e(?: @1 0)?", "upl 1 0", "permissive|upl"),
    ("ms-pl", "microsoft public licen[sc]e", "ms pl", "microsoft|pl"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "ms rl", "reciprocal|rl"),
    ("osl-3", "open software licen[sc]e(?: @3 0)?", "osl 3 0", "open|osl"),
    ("afl-3", "academic free licen[sc]e(?: @[23] [01])?", "afl [23] [01]", "academic|afl"),
    ("ecl-2", "educational community licen[sc]e(?: @2 0)?", "ecl 2 0", "educational|ecl"),
    ("eupl-1.2", "(?:european union public licen[sc]e|eupl)(?: @1 [12])?", "eupl 1 [12]", "european|eupl"),
    ("cecill", "cecill(?: [bc])?(?: free software)?(?: licen[sc]e| @2 [01])?", "cecill(?: 2 [01]| [bc])?", "cecill"),
    ("mulan-2", "mulan (?:psl|permissive software licen[sc]e)(?: @2)?", "mulanpsl 2 0", "mulan|mulanpsl"),
    ("ofl-1.1", "(?:sil )?open font licen[sc]e(?: @1 [01])?", "ofl 1 [01]", "font|ofl"),
    ("odbl-1", "(?:open database licen[sc]e|odbl)(?: @1 0)?", "odbl 1 0", "database|odbl"),
    ("odc-by", "open data commons attribution licen[sc]e(?: @1 0)?", "odc by 1 0", "commons|odc"),
    ("pddl-1", "(?:open data commons )?public domain dedication and licen[sc]e", "pddl 1 0", "dedication|pddl"),
    ("cdla", "community data licen[sc]e agreement(?: permissive| sharing)?(?: @[12] 0)?", "cdla (?:permissive|sharing) [12] 0", "community|cdla"),
    ("ogl", "open government licen[sc]e(?: @[123] 0)?", "ogl(?: uk)? [123] 0", "government|ogl"),
    ("ncgl", "non commercial government licen[sc]e", "ncgl uk 2 0", "government|ncgl"),
    ("cc0", "(?:creative commons (?:zero|cc0)|cc0)(?: @1 0)?(?: universal)?(?: public domain dedication)?", "cc0 1 0", "cc0|zero"),
    ("cc-pdm", "creative commons public domain mark(?: 1 0)?", "cc pdm 1 0", "commons|pdm"),
    ("cc-by", "(?:creative commons attribution|cc by)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", "cc by [1-4] [05]", "commons|cc"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", "cc by sa [1-4] [05]", "commons|cc"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", "cc by nd [1-4] [05]", "commons|cc"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", "cc by nc [1-4] [05]", "commons|cc"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", "cc by nc sa [1-4] [05]", "commons|cc"),
    ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd)(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?", "cc by nc nd [1-4] [05]", "commons|cc"),
    ("openrail", "(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?", "openrail(?: m)?", "openrail|rail"),
    ("commons-clause", "commons clause(?: licen[sc]e)?(?: condition)?(?: @1 0)?", "commons clause", "clause"),
    ("polyform-nc", "polyform non ?commercial licen[sc]e(?: 1 0 0)?", "polyform noncommercial 1 0 0", "polyform"),
    ("json", "json licen[sc]e", "json", "json"),
    ("beerware", "beer ?ware licen[sc]e", "beerware", "beerware|beer"),
]

#: (label, text of a notice, words it needs).
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction", "hereby obtaining"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd-3", "neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products", "endorse"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby fee"),
    ("apache-2", "you may not use this file except in compliance with the licen[sc]e", "compliance"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", "applicable"),
    ("apache-2", "www apache org licenses license 2 0(?: txt| html)?", "apache"),
    ("apache-2", "to (?:you|the asf) under the apache licen[sc]e version 2 0", "apache"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation", "redistribute"),
    ("gpl-2", "gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", "gnu"),
    ("gpl-3", "gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", "gnu"),
    ("gpl-2", "gnu general public licen[sc]e version 2 (?:only )?as published by the free software foundation", "gnu"),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e along with", "gnu"),
    ("gpl", "www gnu org licenses gpl(?: [123] 0)?(?: txt| html)?", "gnu"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with", "gnu"),
    ("lgpl", "www gnu org licenses lgpl(?: [23] [01])?(?: txt| html)?", "gnu"),
    ("lgpl-2.1", "gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e", "gnu"),
    ("lgpl-3", "gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e", "gnu"),
    ("agpl", "you should have received a copy of the gnu affero general public licen[sc]e along with", "affero"),
    ("agpl-3", "gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e", "affero"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "gnu"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "mozilla"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "mozilla"),
    ("mpl", "(?:www )?mozilla org mpl(?: [12] [01])?", "mozilla"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "eclipse"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "development"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", "hereby obtaining"),
    ("bsl-1", "www boost org licen[sc]e 1 0 txt", "boost"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("artistic", "you may redistribute it and or modify it under the same terms as perl(?: itself)?", "perl"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "hereby fee"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted", "hereby fee"),
    ("openssl", "this product includes software developed by the openssl project", "openssl"),
    ("ofl-1.1", "this font software is licen[sc]ed under the sil open font licen[sc]e", "font"),
    ("ofl-1.1", "scripts sil org ofl", "ofl"),
    ("cc0", "to the extent possible under law (?:[^ ]+ ){1,8}(?:has|have) waived all copyright and related or neighbou?ring rights", "waived"),
    ("cc0", "creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("cc-pdm", "creativecommons org publicdomain mark 1 0", "creativecommons"),
    ("cc-by", "creativecommons org licenses by(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-sa", "creativecommons org licenses by sa(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nd", "creativecommons org licenses by nd(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nc", "creativecommons org licenses by nc(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd(?: [1-4] [05])?", "creativecommons"),
    ("odbl-1", "opendatacommons org licenses odbl(?: 1 0)?", "opendatacommons"),
    ("json", "the software shall be used for good not evil", "evil"),
    ("commons-clause", "the licen[sc]e does not grant to you the right to sell the software", "sell"),
    ("beerware", "you can buy me a beer in return", "beer"),
]

#: Weak mentions; anything better that holds them suppresses them.
HINTS = [
    ("public-domain", "(?:released into|placed in|in) the public domain", "domain"),
    ("public-domain", "dedicated to the public domain", "domain"),
    ("proprietary", "all rights reserved", "reserved"),
    ("proprietary", "proprietary and confidential", "proprietary"),
    ("proprietary", "unauthori[sz]ed (?:copying|use|distribution)(?: [^ ]+){0,8} (?:is )?(?:strictly )?prohibited", "prohibited"),
    ("proprietary", "may not be (?:copied|reproduced|redistributed)(?: [^ ]+){0,6} without(?: the)?(?: express)?(?: prior)?(?: written)? (?:permission|consent)", "reproduced|copied|redistributed"),
    ("non-commercial", "(?:for )?non ?commercial(?: use| purposes)(?: only)?", "noncommercial|commercial"),
    ("non-commercial", "(?:for )?(?:academic|research|personal)(?: and (?:academic|research|personal))? (?:use|purposes) only", "academic|research|personal"),
    ("copyleft", "copyleft", "copyleft"),
    ("open-source", "open source licen[sc]e", "license|licence"),
    ("unknown", "(?:licen[sc]ed|distributed|released) under(?: the)?(?: terms of)?(?: the)?(?: [^ ]+){1,4} licen[sc]e", "license|licence"),
    ("unknown", "see(?: the)? licen[sc]e(?: file| txt| md)? (?:for(?: more)? (?:details|information)|in the (?:project|repository) root)", "license|licence"),
]

#: The phrases and labels that the contract fixes.
PHRASES = [("mit", "under the mit license", "mit license"), ("apache-2", "apache license version 2", "apache license"), ("cc-by-nc", "cc by nc", "cc by nc")]

LICENCE = "license|licence"
VERBS = "licen[sc]ed|released|distributed|redistributed|published|provided|offered|available|covered|governed"
UNDER = "(?:under|by|with)(?: the)?(?: terms(?: and conditions)?)?(?: of)?(?: the)?(?: gnu)?"


def _version(pattern: str) -> str:
    """ "@2 0": 2, 2 0, v2, v2 0, version 2, version 2 0; the minor number may be left out only where it is 0."""
    optional = re.sub(r"@(\S+?) (0\??)(?=[^0-9\]]|$)", r"(?:version |v )?v?\1(?: 0)?", pattern)
    return optional.replace("@", "(?:version |v )?v?")


def rules() -> list[Rule]:
    """All rules in order: among equals of a priority and a place, the first wins."""
    out = [Rule(label, "phrase", phrase, needs, base=True) for label, phrase, needs in PHRASES]
    for label, title, short, needs in NAMES:
        title = _version(title)
        named = f"(?:{title}|{short})"
        out += [
            Rule(label, "identifier", f"spdx licen[sc]e identifier {short}", f"spdx {needs}"),
            Rule(label, "grant", f"(?:dual )?(?:{VERBS})(?: [^ ]+){{0,3}}? {UNDER} {named}(?: licen[sc]e)?", needs),
            Rule(label, "grant", f"subject to(?: the)?(?: terms(?: and conditions)?)?(?: of)?(?: the)? {named}", f"{needs} subject"),
            Rule(label, "field", f"licen[sc]es? (?:name |type |id |is )?{short}", f"{needs} {LICENCE}|licenses|licences"),
            Rule(label, "title", title, needs),
        ]
    out += [Rule(label, "text", text, needs) for label, text, needs in TEXTS]
    return out + [Rule(label, "hint", text, needs) for label, text, needs in HINTS]


RULES = rules()
