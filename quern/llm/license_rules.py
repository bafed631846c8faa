"""Licence signatures for :mod:`licenses`: the sentences of ``license_texts``, written out one by
one, and families of names in the forms that they are met in.

Patterns match normalised text: lower-case words, one space between them. Rules are ordered
by priority, then by family, then by form; sentences come last among equals.
"""

from __future__ import annotations

from typing import NamedTuple

from .license_texts import LIC, TEXTS


class Rule(NamedTuple):
    order: int
    label: str
    priority: int  #: 1 is strongest
    keywords: list[str]  #: one must begin at a word of the text for the pattern to be tried; none begins another rule's
    confidence: float
    pattern: str


VER = " ?(?:v|ver|version)? ?"

#: (label, keywords, SPDX identifier as words, name). The name must tell the licence by itself.
FAMILIES: list[tuple[str, str, str, str]] = [
    ("mit", "mit lic|mit style lic|expat lic|expat style lic", "mit", f"(?:mit|expat) (?:style )?{LIC}"),
    ("mit-0", "mit no attribution", "mit 0", f"mit no attribution(?: {LIC})?"),
    ("apache-1.1", "apache", "apache 1 1", f"apache (?:software )?{LIC}{VER}1 1"),
    ("apache-2", "apache", "apache 2 0", f"apache(?: software)?(?: {LIC})?{VER}2(?: 0)?"),
    ("apache", "apache", "apache", f"apache (?:software )?{LIC}"),
    ("bsd-0-clause", "bsd|0bsd|zero clause", "0bsd", f"(?:bsd zero clause|zero clause bsd|0bsd)(?: {LIC})?"),
    ("bsd-2-clause", "bsd|2 clause|two clause|simplified|freebsd", "bsd 2 clause", f"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: {LIC})?"),
    ("bsd-3-clause", "bsd|3 clause|three clause|new bsd|revised|modified", "bsd 3 clause", f"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|revised|modified) bsd)(?: {LIC})?"),
    ("bsd-4-clause", "bsd|4 clause|four clause|original", "bsd 4 clause", f"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: {LIC})?"),
    ("bsd", "bsd", "bsd", f"bsd (?:style )?{LIC}"),
    ("gpl-1.0", "gpl|general public", "gpl 1 0(?: only| or later)?", f"(?:gnu )?(?:gpl|general public {LIC}){VER}1(?: 0)?"),
    ("gpl-2.0", "gpl|general public", "gpl 2 0(?: only| or later)?", f"(?:gnu )?(?:gpl|general public {LIC}){VER}2(?: 0)?"),
    ("gpl-3.0", "gpl|general public", "gpl 3 0(?: only| or later)?", f"(?:gnu )?(?:gpl|general public {LIC}){VER}3(?: 0)?"),
    ("gpl", "gpl|general public", "gpl", f"gnu (?:gpl|general public {LIC})"),
    ("lgpl-2.0", "lgpl|general public", "lgpl 2 0(?: only| or later)?", f"(?:gnu )?(?:lgpl|library general public {LIC}){VER}2(?: 0)?"),
    ("lgpl-2.1", "lgpl|general public", "lgpl 2 1(?: only| or later)?", f"(?:gnu )?(?:lgpl|lesser general public {LIC}){VER}2 1"),
    ("lgpl-3.0", "lgpl|general public", "lgpl 3 0(?: only| or later)?", f"(?:gnu )?(?:lgpl|lesser general public {LIC}){VER}3(?: 0)?"),
    ("lgpl", "lgpl|general public", "lgpl", f"(?:gnu )?(?:lgpl|lesser general public {LIC})"),
    ("agpl-3.0", "agpl|affero", "agpl 3 0(?: only| or later)?", f"(?:gnu )?(?:agpl|affero general public {LIC})(?:{VER}3(?: 0)?)?"),
    ("gfdl", "gnu free doc", "gfdl 1 [123](?: only| or later)?", f"gnu free documentation {LIC}"),
    ("mpl-1.1", "mozilla public", "mpl 1 1", f"mozilla public {LIC}{VER}1 1"),
    ("mpl-2.0", "mozilla public", "mpl 2 0", f"mozilla public {LIC}{VER}2(?: 0)?"),
    ("mpl", "mozilla public", "mpl", f"mozilla public {LIC}"),
    ("epl-1.0", "eclipse public", "epl 1 0", f"eclipse public {LIC}{VER}1(?: 0)?"),
    ("epl-2.0", "eclipse public", "epl 2 0", f"eclipse public {LIC}{VER}2(?: 0)?"),
    ("epl", "eclipse public", "epl", f"eclipse public {LIC}"),
    ("eupl", "european union public", "eupl 1 [012]", f"european union public {LIC}"),
    ("cddl", "common development", "cddl 1 [01]", f"common development and distribution {LIC}"),
    ("cpl", "common public", "cpl 1 0", f"common public {LIC}"),
    ("artistic", "artistic", "artistic [12] 0", f"artistic {LIC}"),
    ("boost", "boost software", "bsl 1 0", f"boost software {LIC}"),
    ("isc", "isc lic", "isc", f"isc {LIC}"),
    ("zlib", "zlib", "zlib", f"zlib(?: libpng)? {LIC}"),
    ("unlicense", "unlicense", "unlicense", "the unlicense"),
    ("wtfpl", "wtfpl|want to public", "wtfpl", "wtfpl|do what the f[a-z]* you want to public licen[sc]e"),
    ("python", "python lic|python software", "python 2 0", f"python (?:software foundation )?{LIC}"),
    ("php", "php lic", "php 3 0[01]?", f"php {LIC}"),
    ("postgresql", "postgresql", "postgresql", f"postgresql {LIC}"),
    ("openssl", "openssl", "openssl", f"openssl {LIC}"),
    ("ofl", "sil open|open font", "ofl 1 [01]", f"(?:sil )?open font {LIC}"),
    ("ms-pl", "microsoft public", "ms pl", f"microsoft public {LIC}"),
    ("ms-rl", "microsoft rec", "ms rl", f"microsoft reciprocal {LIC}"),
    ("osl", "open software lic", "osl [123] [01]", f"open software {LIC}"),
    ("odbl", "open data", "odbl 1 0", f"open (?:data commons open )?database {LIC}"),
    ("odc-by", "open data commons", "odc by 1 0", f"open data commons attribution {LIC}"),
    ("pddl", "public domain ded", "pddl 1 0", f"public domain dedication and {LIC}"),
    ("open-government", "open government", "ogl uk [123] 0", f"open government {LIC}"),
    ("bsl", "business source", "busl 1 1", f"business source {LIC}"),
    ("sspl", "server side", "sspl 1 0", f"server side public {LIC}"),
    ("elastic", "elastic lic", "elastic 2 0", f"elastic {LIC}"),
    ("openrail", "openrail|open rail|creativeml", "openrail(?: m)?", "(?:creativeml )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("cc0", "cc|creative commons zero", "cc0 1 0", "cc0|creative commons zero"),
    ("cc-by-nc-nd", "cc", "cc by nc nd [1-4] [05]", "cc by nc nd"),
    ("cc-by-nc-sa", "cc", "cc by nc sa [1-4] [05]", "cc by nc sa"),
    ("cc-by-nc", "cc", "cc by nc [1-4] [05]", "cc by nc"),
    ("cc-by-nd", "cc", "cc by nd [1-4] [05]", "cc by nd"),
    ("cc-by-sa", "cc", "cc by sa [1-4] [05]", "cc by sa"),
    ("cc-by", "cc", "cc by [1-4] [05]", "cc by"),
    ("cc-by-nc-nd", "creative", "creative commons by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", "creative", "creative commons by nc sa", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative", "creative commons by nc", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", "creative commons by nd", "creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-sa", "creative", "creative commons by sa", "creative commons attribution share ?alike"),
    ("cc-by", "creative", "creative commons by", "creative commons attribution"),
    ("public-domain", "dedicated to the public|released into|placed in|in the public domain", "public domain", "(?:dedicated to|released into|placed in|in) the public domain"),
    ("proprietary", "proprietary", "licenseref proprietary", f"(?:proprietary (?:and confidential|{LIC}))"),
    ("all-rights-reserved", "all rights reserved", "licenseref all rights reserved", "all rights reserved"),
    ("all-rights-reserved", "droits", "droits réservés", "tous droits réservés"),
    ("all-rights-reserved", "rechte", "rechte vorbehalten", "alle rechte vorbehalten"),
    ("all-rights-reserved", "derechos", "derechos reservados", "todos los derechos reservados"),
]

#: (priority, confidence, pattern around the identifier ``{i}`` or the name ``{n}``, and its keywords if they aren't the name's).
FORMS: list[tuple[int, float, str, str]] = [
    (1, 1.0, f"spdx {LIC} identifier (?:{{i}})", "spdx lic"),
    (2, 1.0, f"spdx {LIC} identifier (?:[a-z0-9]+ ){{{{1,12}}}}?(?:or|and) (?:{{i}})", "spdx lic"),
    (1, 0.98, "(?:opensource|spdx) org (?:licenses|license) (?:{i})", "opensource org|spdx org"),
    (2, 0.95, "(?:licensed|licenced|released|distributed|published|provided|available) under (?:the )?(?:terms of (?:the )?)?(?:{n})", ""),
    (3, 0.9, "(?:under|see|per|subject to|governed by|according to|accordance with) (?:the )?(?:terms of (?:the )?)?(?:{n})", ""),
    (4, 0.7, "(?:{n})", ""),
]


def rules() -> list[Rule]:
    """All rules in order: some hundreds, of which ``TEXTS`` are those of whole sentences."""
    made = [
        (priority, f, family[0], keywords or family[1], confidence, form.format(i=family[2], n=family[3]))
        for f, family in enumerate(FAMILIES)
        for priority, confidence, form, keywords in FORMS
    ]
    made += [(priority, len(FAMILIES) + f, label, keywords, confidence, pattern) for f, (label, priority, confidence, keywords, pattern) in enumerate(TEXTS)]
    made.sort(key=lambda m: (m[0], m[1]))
    words = sorted({k for m in made for k in m[3].split("|")})
    # a keyword that begins with another one gives way to it
    shortest = {k: min((w for w in words if k.startswith(w)), key=len) for k in words}
    return [Rule(k, label, priority, sorted({shortest[w] for w in keywords.split("|")}), confidence, pattern) for k, (priority, _, label, keywords, confidence, pattern) in enumerate(made)]


def keyword_pattern(table: list[Rule]) -> str:
    """Captures, at each word, the keyword that begins there; there is one at most."""
    by_letter: dict[str, list[str]] = {}
    for k in sorted({k for r in table for k in r.keywords}):
        by_letter.setdefault(k[0], []).append(k[1:])
    return "(?<= )(?=(" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + "))"
