"""The rules of the license scan, by hand, in order of priority.

A pattern is a regular expression over words: lower-cased, one space between them, whole words only.  Each license has keywords
(``|`` between them) one of which every match has, and a pattern for its name; its tag, address, grant and name are rules of their own.
More particular licenses stand before the families they belong to.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rank: int
    label: str | None
    score: float
    keyword: str
    pattern: str


L = "licen[cs]e"
V = "(?: v| version)?"

#: Places that speak of a license and grant none: keyword, pattern.
NOTHING = [
    ("license", "driv(?:ing|ers?|er s) license"), ("licence", "driv(?:ing|ers?|er s) licence"), ("license", "license plates?"), ("licence", "licence plates?"), ("license", "(?:marriage|fishing|hunting|liquor|pilots?|gun|dog|tv) license"),
    ("licence", "(?:marriage|fishing|hunting|liquor|pilots?|gun|dog|tv) licence"), ("license", "license (?:key|number|fees?|server|agreement number)"), ("license", "(?:artistic|poetic|creative) license (?:to|with|in) [^ #]+"), ("mit", "mit (?:press|media lab|sloan|professors?|students?|researchers?|technology review)"),
    ("apache", "apache (?:helicopters?|tribes?|people|nation|county)"), ("bsd", "bsd (?:unix|kernel|sockets?)"), ("license", "license expired"), ("license", "license to (?:kill|practi[cs]e|drive|operate)"), ("rights", "human rights reserved"),
]

#: Sentences of license texts and notices: label, keyword, pattern.
TEXTS = [
    ("mit", "sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: [^ #]+){4,30} sublicense"),
    ("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "noninfringement", "(?:fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders)"),
    ("isc", "fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause", "endorse", "neither the names? of(?: [^ #]+){1,12} may be used to endorse or promote products"),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("lgpl-2.1-or-later", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", "library", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-or-later", "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "merchantability", "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu(?: [^ #]+)? general public license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "development", "the contents of this file are subject to the terms of the common development and distribution license(?: the license| cddl)"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"), ("beerware", "beer", "you can buy me a beer in return"),
    ("zlib", "arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"), ("json", "evil", "the software shall be used for good not evil"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights"),
    ("public-domain", "domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain"), ("public-domain", "domain", "this work is in the public domain"),
    ("ofl-1.1", "sil", "this font software is licensed under the sil open font license version 1 1"),
    ("gfdl-1.3-or-later", "documentation", "under the terms of the gnu free documentation license version 1 3 or any later version"),
    ("gfdl-1.2-or-later", "documentation", "under the terms of the gnu free documentation license version 1 2 or any later version"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"), ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"), ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|work|material|document)(?: via any medium)? is strictly prohibited"),
    ("reserved", "reserved", "(?:all )?rights reserved no part of this (?:publication|work|book|document) may be reproduced"), ("commercial", "commercial", "commercial (?:license|licence) (?:is )?(?:required|available)"),
]

#: Licenses: label, keyword, name.  The tag of a label is the label itself, by words.
NAMES = [
    ("apache-2.0", "apache", f"apache(?: software)?(?: {L})?{V} 2(?: 0)?"), ("apache-1.1", "apache", f"apache(?: software)?(?: {L})?{V} 1 1"), ("apache-1.0", "apache", f"apache(?: software)?(?: {L})?{V} 1 0"), ("apache", "apache", f"apache(?: software| public)? {L}"),
    ("mit-0", "mit", f"(?:mit 0|mit no attribution)(?: {L})?"), ("mit", "mit|x11|expat", f"(?:mit|x11|expat|mit x11|mit expat)(?: style)? {L}"), ("x11", "x11", f"x11 {L}"), ("isc", "isc", f"isc {L}"), ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {L}"),
    ("bsd-4-clause", "bsd", f"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd|old bsd)(?: {L})?"), ("bsd-3-clause", "bsd", f"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd|bsd new)(?: {L})?"),
    ("bsd-2-clause", "bsd|freebsd", f"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: {L})?"), ("0bsd", "bsd", f"(?:zero clause bsd|bsd zero clause)(?: {L})?"), ("bsd", "bsd", f"bsd(?: style)? {L}"),
    ("agpl-3.0-or-later", "affero", f"(?:gnu )?affero general public {L}{V} 3(?: 0)? or (?:any )?later"), ("agpl-3.0", "affero", f"(?:gnu )?affero general public {L}{V} 3(?: 0)?"), ("agpl", "affero", f"(?:gnu )?affero general public {L}"), ("agpl-3.0", "agpl", f"(?:gnu )?agpl{V} 3(?: 0)?"), ("agpl-3.0", "agplv3", "(?:gnu )?agplv3"), ("agpl", "agpl", "(?:gnu )?agpl"),
    ("lgpl-2.1-or-later", "lesser", f"(?:gnu )?lesser general public {L}{V} 2 1 or (?:any )?later"), ("lgpl-3.0-or-later", "lesser", f"(?:gnu )?lesser general public {L}{V} 3(?: 0)? or (?:any )?later"), ("lgpl-2.1", "lesser", f"(?:gnu )?lesser general public {L}{V} 2 1"), ("lgpl-3.0", "lesser", f"(?:gnu )?lesser general public {L}{V} 3(?: 0)?"),
    ("lgpl-2.0", "library", f"(?:gnu )?library general public {L}{V} 2(?: 0)?"), ("lgpl", "lesser", f"(?:gnu )?lesser general public {L}"), ("lgpl", "library", f"(?:gnu )?library general public {L}"), ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl{V} 2 1"), ("lgpl-3.0", "lgpl", f"(?:gnu )?lgpl{V} 3(?: 0)?"), ("lgpl-3.0", "lgplv3", "(?:gnu )?lgplv3"), ("lgpl-2.1", "lgplv2", "(?:gnu )?lgplv2 1"), ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("gpl-3.0-or-later", "general", f"(?:gnu )?general public {L}{V} 3(?: 0)? or (?:any )?later"), ("gpl-2.0-or-later", "general", f"(?:gnu )?general public {L}{V} 2(?: 0)? or (?:any )?later"), ("gpl-3.0", "general", f"(?:gnu )?general public {L}{V} 3(?: 0)?"), ("gpl-2.0", "general", f"(?:gnu )?general public {L}{V} 2(?: 0)?"), ("gpl-1.0", "general", f"(?:gnu )?general public {L}{V} 1(?: 0)?"),
    ("gpl", "general", f"(?:gnu )?general public {L}"), ("gpl-3.0", "gpl", f"(?:gnu )?gpl{V} 3(?: 0)?"), ("gpl-2.0", "gpl", f"(?:gnu )?gpl{V} 2(?: 0)?"), ("gpl-3.0", "gplv3", "(?:gnu )?gplv3"), ("gpl-2.0", "gplv2", "(?:gnu )?gplv2"), ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gfdl-1.3", "documentation", f"(?:gnu )?free documentation {L}{V} 1 3"), ("gfdl-1.2", "documentation", f"(?:gnu )?free documentation {L}{V} 1 2"), ("gfdl", "documentation", f"(?:gnu )?free documentation {L}"),
    ("mpl-2.0", "mozilla", f"mozilla public {L}{V} 2(?: 0)?"), ("mpl-1.1", "mozilla", f"mozilla public {L}{V} 1 1"), ("mpl", "mozilla", f"mozilla public {L}"), ("mpl-2.0", "mpl", f"mpl{V} 2(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public {L}{V} 2(?: 0)?"), ("epl-1.0", "eclipse", f"eclipse public {L}{V} 1(?: 0)?"), ("epl", "eclipse", f"eclipse public {L}"), ("eupl-1.2", "european", f"european union public {L}{V} 1 2"), ("eupl-1.1", "european", f"european union public {L}{V} 1 1"), ("eupl", "eupl", "eupl"),
    ("cddl-1.1", "cddl", f"cddl{V} 1 1"), ("cddl-1.0", "cddl", f"cddl{V} 1(?: 0)?"), ("cddl", "development", f"common development and distribution {L}"), ("cpl-1.0", "common", f"common public {L}{V} 1 0"), ("cpal-1.0", "attribution", f"common public attribution {L}"), ("ipl-1.0", "ibm", f"ibm public {L}"), ("spl-1.0", "sun", f"sun public {L}"),
    ("cecill-2.1", "cecill", f"cecill{V} 2 1"), ("cecill-b", "cecill", "cecill b"), ("cecill-c", "cecill", "cecill c"), ("cecill", "cecill", f"cecill(?: {L})?"), ("artistic-2.0", "artistic", f"artistic {L}{V} 2(?: 0)?"), ("artistic-1.0", "artistic", f"(?:perl )?artistic {L}{V} 1(?: 0)?"), ("perl", "perl", "same terms as perl(?: itself)?"),
    ("bsl-1.0", "boost", f"boost(?: software)? {L}"), ("busl-1.1", "business", f"business source {L}"), ("sspl-1.0", "server", f"server side public {L}"), ("elastic-2.0", "elastic", f"elastic {L}{V} 2(?: 0)?"), ("elastic", "elastic", f"elastic {L}"), ("zlib", "zlib", f"zlib(?: libpng)? {L}"), ("libpng", "libpng", f"libpng {L}"),
    ("psf-2.0", "python", f"python software foundation {L}"), ("python-2.0", "python", f"python {L}(?:{V} 2(?: 0)?)?"), ("php-3.01", "php", f"php {L}{V} 3 01"), ("php", "php", f"php {L}"), ("ruby", "ruby", f"ruby {L}"), ("openssl", "openssl", f"openssl {L}"), ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {L}"), ("postgresql", "postgresql", f"postgresql {L}"),
    ("unlicense", "unlicense", "(?:the )?unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("beerware", "beerware", "beerware"), ("upl-1.0", "universal", f"universal permissive {L}"), ("ms-pl", "microsoft", f"microsoft public {L}"), ("ms-rl", "microsoft", f"microsoft reciprocal {L}"), ("osl-3.0", "open", f"open software {L}{V} 3(?: 0)?"), ("afl-3.0", "academic", f"academic free {L}"),
    ("ecl-2.0", "educational", f"educational community {L}"), ("ofl-1.1", "font", f"(?:sil )?open font {L}"), ("odbl-1.0", "database", f"open (?:data commons )?(?:open )?database {L}"), ("odc-by-1.0", "commons", f"open data commons attribution {L}"), ("pddl-1.0", "dedication", "public domain dedication and license"), ("mulan-psl-2.0", "mulan", f"mulan (?:psl|permissive software {L})"),
    ("openrail", "openrail", f"(?:[^ #]+ )?openrail(?: m)?(?: {L})?"), ("llama", "llama", f"llama [0-9](?: [0-9])? community {L}"), ("cc0-1.0", "cc0", "cc0(?: 1 0)?"), ("cc0-1.0", "zero", "creative commons zero"),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0"), ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0"), ("cc-by-nc-4.0", "cc", "cc by nc 4 0"), ("cc-by-nd-4.0", "cc", "cc by nd 4 0"), ("cc-by-sa-4.0", "cc", "cc by sa 4 0"), ("cc-by-4.0", "cc", "cc by 4 0"),
    ("cc-by-nc-nd-3.0", "cc", "cc by nc nd 3 0"), ("cc-by-nc-sa-3.0", "cc", "cc by nc sa 3 0"), ("cc-by-nc-3.0", "cc", "cc by nc 3 0"), ("cc-by-nd-3.0", "cc", "cc by nd 3 0"), ("cc-by-sa-3.0", "cc", "cc by sa 3 0"), ("cc-by-3.0", "cc", "cc by 3 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd"), ("cc-by-nc-sa", "cc", "cc by nc sa"), ("cc-by-nc", "cc", "cc by nc"), ("cc-by-nd", "cc", "cc by nd"), ("cc-by-sa", "cc", "cc by sa"), ("cc-by", "cc", "cc by"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non(?: )?commercial no deriv(?:s|atives|ative works)"), ("cc-by-nc-sa", "commons", "creative commons attribution non(?: )?commercial share(?: )?alike"), ("cc-by-nc", "commons", "creative commons attribution non(?: )?commercial"), ("cc-by-nd", "commons", "creative commons attribution no(?: )?deriv(?:s|atives|ative works)"),
    ("cc-by-sa", "commons", "creative commons attribution share(?: )?alike"), ("cc-by", "commons", "creative commons attribution"), ("cc", "commons", f"creative commons(?: {L})?"),
]

#: References that name no license: label, keyword, pattern.
LOOSE = [
    ("see-license", "license", "see (?:the )?(?:accompanying )?license(?: txt| md| file)?(?: file)?(?: for (?:details|more information|terms))?"), ("see-license", "licence", "see (?:the )?(?:accompanying )?licence(?: txt| md| file)?(?: file)?"), ("licensed", "licensed", "licensed (?:under|by|to|from)"), ("licensed", "license", "under (?:the|a|an) [^ #]+ license"),
    ("open-source", "source", "(?:free and )?open source (?:software|license)"), ("proprietary", "proprietary", "proprietary (?:software|license)"), ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]"), ("reserved", "reserved", "(?:some|no|all) rights reserved"), ("permission", "permission", "(?:used|reprinted|reproduced) (?:by|with) (?:kind )?permission"),
]

GRANT = "(?:(?:is|are) )?(?:licensed|released|distributed|published|available|covered|provided|offered|issued|governed|shared|made available) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"


def _rules() -> list[Rule]:
    rows: list[tuple[str | None, float, str, str]] = [(None, 0.0, k, p) for k, p in NOTHING]
    rows += [(label, 1.0, k, p) for label, k, p in TEXTS]
    tags = {label: label.replace("-", " ").replace(".", " ") for label, _, _ in NAMES}
    # A longer tag may begin like a shorter one.
    tags = dict(sorted(tags.items(), key=lambda x: -len(x[1])))
    rows += [(label, 1.0, "spdx", f"spdx license identifier {tag}") for label, tag in tags.items()]
    rows += [(label, 0.95, "licenses", f"(?:opensource|spdx|gnu|apache) org licenses {tag}") for label, tag in tags.items() if not label.startswith("cc-")]
    rows += [(label, 0.95, "creativecommons", f"creativecommons org licenses {tag[3:]}") for label, tag in tags.items() if label.startswith("cc-")]
    rows += [(label, 0.95, k, GRANT + f"(?:{p})") for label, k, p in NAMES]
    rows += [(label, 0.8, k, p) for label, k, p in NAMES]
    rows += [(label, 0.4, k, p) for label, k, p in LOOSE]
    return [Rule(i, *r) for i, r in enumerate(rows)]


RULES = _rules()
