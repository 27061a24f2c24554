"""License signatures: names, wordings and identifiers, from which the ordered rules are made."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What may stand between two words of a notice: white space, comment leaders, quotes and the like.
#: A gap is taken whole or not at all, so that optional words between gaps cost no more than a look at each.
GAP = r"[^0-9a-z\x80-\xff]++"


@dataclass(frozen=True)
class Rule:
    """A signature. Rules are tried only in texts that hold one of ``keywords``, whatever gaps are between its words; a lower ``priority`` wins."""

    name: str
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


# Labels after public license identifiers, a keyword that any naming of the license
# holds (or several, of which it holds one), and regexes for its names. A blank in a regex stands for a gap between words.
_NAMED = [
    ("apache-1.0", "apache", [r"apache (?:software )?license,? (?:version )?1\.0"]),
    ("apache-1.1", "apache", [r"apache (?:software )?license,? (?:version )?1\.1"]),
    ("apache-2.0", "apache", [r"apache (?:software )?license,? (?:version|v\.?)? ?2(?:\.0)?", r"apache 2(?:\.0)? licen[sc]e", r"apache 2\.0"]),
    ("apache", "apache", [r"apache (?:software |public )?licen[sc]e"]),
    ("mit", "mit", [r"the mit licen[sc]e", r"mit licen[sc]e", r"mit x11 licen[sc]e", r"licensed under (?:the )?mit"]),
    ("mit-0", "mit", [r"mit no attribution"]),
    ("bsd-2-clause", "bsd", [r"bsd 2 clause", r"simplified bsd", r"two clause bsd", r"freebsd licen[sc]e"]),
    ("bsd-3-clause", "bsd", [r"bsd 3 clause", r"new bsd", r"modified bsd", r"revised bsd", r"three clause bsd"]),
    ("bsd-4-clause", "bsd", [r"bsd 4 clause", r"original bsd", r"four clause bsd"]),
    ("0bsd", "bsd", [r"zero clause bsd", r"bsd zero clause"]),
    ("bsd", ("bsd", "berkeley"), [r"bsd (?:style )?licen[sc]e", r"berkeley software distribution licen[sc]e"]),
    ("gpl-1.0", "g", [r"gnu (?:gpl|general public licen[sc]e),? (?:version |v)1"]),
    ("gpl-2.0", "g", [r"gnu (?:gpl|general public licen[sc]e),? (?:as published .{0,80}?either )?(?:version |v)2", r"gpl ?v?2(?:\.0)?"]),
    ("gpl-3.0", "g", [r"gnu (?:gpl|general public licen[sc]e),? (?:as published .{0,80}?either )?(?:version |v)3", r"gpl ?v?3(?:\.0)?"]),
    ("gpl", "g", [r"gnu general public licen[sc]e", r"gnu gpl"]),
    ("lgpl-2.0", "general public", [r"gnu (?:library|lesser) general public licen[sc]e,? (?:version |v)2(?:\.0)?"]),
    ("lgpl-2.1", "lesser", [r"gnu lesser general public licen[sc]e,? (?:version |v)2\.1"]),
    ("lgpl-3.0", "lesser", [r"gnu lesser general public licen[sc]e,? (?:version |v)3"]),
    ("lgpl", "lgpl", [r"gnu lgpl", r"lgpl ?v?[23](?:\.[01])?", r"under the lgpl"]),
    ("lgpl", "general public", [r"gnu lesser general public licen[sc]e", r"gnu library general public licen[sc]e"]),
    ("agpl-3.0", "affero", [r"affero general public licen[sc]e,? (?:version |v)3"]),
    ("agpl", "affero", [r"gnu affero general public licen[sc]e", r"affero general public licen[sc]e"]),
    ("agpl", "agpl", [r"gnu agpl", r"agpl ?v?3(?:\.0)?"]),
    ("gfdl-1.1", "documentation", [r"gnu free documentation licen[sc]e,? (?:version |v)1\.1"]),
    ("gfdl-1.2", "documentation", [r"gnu free documentation licen[sc]e,? (?:version |v)1\.2"]),
    ("gfdl-1.3", "documentation", [r"gnu free documentation licen[sc]e,? (?:version |v)1\.3"]),
    ("gfdl", "documentation", [r"gnu free documentation licen[sc]e", r"free documentation licen[sc]e"]),
    ("mpl-1.0", "mozilla", [r"mozilla public licen[sc]e,? (?:version |v)?1\.0"]),
    ("mpl-1.1", "mozilla", [r"mozilla public licen[sc]e,? (?:version |v)?1\.1"]),
    ("mpl-2.0", "mozilla", [r"mozilla public licen[sc]e,? (?:version |v)?\.? ?2(?:\.0)?"]),
    ("mpl", "mozilla", [r"mozilla public licen[sc]e"]),
    ("epl-1.0", "eclipse", [r"eclipse public licen[sc]e,? (?:version |v)?1\.0"]),
    ("epl-2.0", "eclipse", [r"eclipse public licen[sc]e,? (?:version |v)?2\.0"]),
    ("epl", "eclipse", [r"eclipse public licen[sc]e"]),
    ("edl-1.0", "eclipse", [r"eclipse distribution licen[sc]e"]),
    ("cddl-1.0", "common development", [r"common development and distribution licen[sc]e,? (?:version |v)?1\.0"]),
    ("cddl-1.1", "common development", [r"common development and distribution licen[sc]e,? (?:version |v)?1\.1"]),
    ("cddl", "common development", [r"common development and distribution licen[sc]e"]),
    ("cpl-1.0", "common public", [r"common public licen[sc]e"]),
    ("cpal-1.0", "common public", [r"common public attribution licen[sc]e"]),
    ("eupl-1.1", "european union", [r"european union public licen[sc]e,? (?:version |v)?\.? ?1\.1"]),
    ("eupl-1.2", "european union", [r"european union public licen[sc]e,? (?:version |v)?\.? ?1\.2"]),
    ("eupl", "european union", [r"european union public licen[sc]e"]),
    ("cecill-2.1", "cecill", [r"cecill (?:version |v)?2(?:\.1)?"]),
    ("cecill-b", "cecill", [r"cecill b"]),
    ("cecill-c", "cecill", [r"cecill c"]),
    ("cecill", "cecill", [r"licence cecill", r"cecill licen[sc]e"]),
    ("artistic-1.0", "artistic", [r"artistic licen[sc]e,? (?:version |v)?1\.0"]),
    ("artistic-2.0", "artistic", [r"artistic licen[sc]e,? (?:version |v)?2\.0"]),
    ("artistic", ("artistic", "as perl itself"), [r"artistic licen[sc]e", r"same terms as perl itself"]),
    ("isc", "isc", [r"isc licen[sc]e", r"internet systems consortium licen[sc]e"]),
    ("zlib", "zlib", [r"zlib licen[sc]e", r"zlib libpng licen[sc]e"]),
    ("libpng", "libpng", [r"libpng licen[sc]e"]),
    ("bsl-1.0", "boost", [r"boost software licen[sc]e,? (?:version )?1\.0", r"boost software licen[sc]e"]),
    ("busl-1.1", "business source", [r"business source licen[sc]e,? (?:version )?1\.1", r"business source licen[sc]e"]),
    ("sspl-1.0", "server side", [r"server side public licen[sc]e"]),
    ("elastic-2.0", "elastic", [r"elastic licen[sc]e,? (?:version )?2\.0", r"elastic licen[sc]e"]),
    ("unlicense", "unlicense", [r"the unlicense", r"unlicense\.org"]),
    ("wtfpl", "what the", [r"do what the f\w+ you want to public licen[sc]e"]),
    ("wtfpl", "wtfpl", [r"wtfpl"]),
    ("beerware", "beer", [r"beer ?ware licen[sc]e", r"buy me a beer in return"]),
    ("ncsa", "ncsa", [r"university of illinois ncsa open source licen[sc]e", r"ncsa open source licen[sc]e"]),
    ("postgresql", "postgresql", [r"postgresql licen[sc]e"]),
    ("openssl", "openssl", [r"openssl licen[sc]e", r"openssl project for use in the openssl toolkit"]),
    ("python-2.0", "python", [r"python software foundation licen[sc]e", r"psf licen[sc]e agreement for python"]),
    ("php-3.01", "php", [r"php licen[sc]e,? (?:version |v)?3\.01"]),
    ("php-3.0", "php", [r"php licen[sc]e,? (?:version |v)?3\.0"]),
    ("ruby", "ruby", [r"ruby licen[sc]e", r"same terms as ruby"]),
    ("w3c", "w3c", [r"w3c software notice and licen[sc]e", r"w3c software licen[sc]e", r"w3c document licen[sc]e"]),
    ("ofl-1.0", "open font", [r"sil open font licen[sc]e,? (?:version )?1\.0"]),
    ("ofl-1.1", "open font", [r"sil open font licen[sc]e,? (?:version )?1\.1"]),
    ("ofl", "open font", [r"open font licen[sc]e"]),
    ("ms-pl", "microsoft", [r"microsoft public licen[sc]e"]),
    ("ms-rl", "microsoft", [r"microsoft reciprocal licen[sc]e"]),
    ("ms-ltrl", "microsoft", [r"microsoft limited reciprocal licen[sc]e"]),
    ("apsl-2.0", "apple", [r"apple public source licen[sc]e"]),
    ("ibm-pl", "ibm", [r"ibm public licen[sc]e"]),
    ("intel", "intel", [r"intel open source licen[sc]e"]),
    ("nokia", "nokia", [r"nokia open source licen[sc]e"]),
    ("osl-3.0", "open software", [r"open software licen[sc]e,? (?:version |v)?\.? ?3\.0", r"open software licen[sc]e"]),
    ("afl-3.0", "academic", [r"academic free licen[sc]e,? (?:version |v)?\.? ?3\.0", r"academic free licen[sc]e"]),
    ("upl-1.0", "universal", [r"universal permissive licen[sc]e"]),
    ("vim", "vim", [r"vim licen[sc]e"]),
    ("tcl", "tcl", [r"tcl tk licen[sc]e"]),
    ("curl", "curl", [r"curl licen[sc]e"]),
    ("ijg", "jpeg", [r"independent jpeg group licen[sc]e", r"work of the independent jpeg group"]),
    ("freetype", "freetype", [r"freetype project licen[sc]e", r"freetype licen[sc]e"]),
    ("imagemagick", "imagemagick", [r"imagemagick licen[sc]e"]),
    ("json", "json", [r"json licen[sc]e"]),
    ("json", "for good", [r"shall be used for good not evil"]),
    ("odbl", "open database", [r"open database licen[sc]e"]),
    ("odc-by", "open data commons", [r"open data commons attribution licen[sc]e"]),
    ("pddl", "public domain dedication", [r"public domain dedication and licen[sc]e"]),
    ("ogl-uk-3.0", "open government", [r"open government licen[sc]e,? (?:version |v)?3\.0", r"open government licen[sc]e"]),
    ("mulan-2.0", "mulan", [r"mulan (?:permissive software licen[sc]e|psl),? (?:version |v)?2", r"mulan permissive software licen[sc]e"]),
    ("rail", ("responsible ai", "openrail"), [r"responsible ai licen[sc]e", r"openrail(?: m)?"]),
    ("llama", "llama", [r"llama \d? ?community licen[sc]e"]),
    ("polyform", "polyform", [r"polyform (?:noncommercial|strict|shield|perimeter|small business) licen[sc]e"]),
    ("commons-clause", "commons clause", [r"commons clause licen[sc]e condition", r"commons clause"]),
    ("hippocratic", "hippocratic", [r"hippocratic licen[sc]e"]),
    ("parity", "parity", [r"parity public licen[sc]e"]),
    ("blueoak-1.0.0", "blue oak", [r"blue oak model licen[sc]e"]),
    ("zpl-2.1", "zope", [r"zope public licen[sc]e"]),
    ("qpl-1.0", "q public", [r"q public licen[sc]e"]),
    ("sleepycat", "sleepycat", [r"sleepycat licen[sc]e"]),
    ("watcom", "watcom", [r"sybase open watcom public licen[sc]e"]),
    ("nasa-1.3", "nasa", [r"nasa open source agreement"]),
    ("lppl-1.3c", "latex", [r"latex project public licen[sc]e"]),
    ("rpl-1.5", "reciprocal public", [r"reciprocal public licen[sc]e"]),
    ("sissl", "sun industry", [r"sun industry standards source licen[sc]e"]),
    ("spl-1.0", "sun public", [r"sun public licen[sc]e"]),
    ("naumen", "naumen", [r"naumen public licen[sc]e"]),
    ("motosoto", "motosoto", [r"motosoto open source licen[sc]e"]),
    ("fair", "fair", [r"fair licen[sc]e"]),
    ("entessa", "entessa", [r"entessa public licen[sc]e"]),
    ("eiffel-2", "eiffel", [r"eiffel forum licen[sc]e"]),
    ("ecl-2.0", "educational", [r"educational community licen[sc]e"]),
    ("cua-opl", "cua office", [r"cua office public licen[sc]e"]),
    ("cnri-python", "cnri", [r"cnri (?:open source|python) licen[sc]e"]),
    ("aal", "attribution assurance", [r"attribution assurance licen[sc]e"]),
    ("oset-pl", "oset", [r"oset (?:foundation )?public licen[sc]e"]),
    ("proprietary", "proprietary", [r"proprietary and confidential", r"proprietary licen[sc]e", r"confidential and proprietary"]),
    ("public-domain", "public domain", [r"(?:released|placed|dedicated) (?:in|into|to) the public domain", r"this (?:work|file|software|text) is in the public domain", r"public domain work"]),
]

# Sentences that license texts and notices are known by.
_WORDING = [
    ("mit", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", "shall be included in all", r"copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission to use", r"permission to use,? copy,? modify,? and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "apache.org", r"apache\.org licenses license 2\.0"),
    ("apache-2.0", "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e"),
    ("gpl", "free software", r"this (?:program|file|library) is free software[;:,]? you can redistribute it"),
    ("gpl", "any later version", r"either version [123](?:\.\d)? of the licen[sc]e,? or \(?at your option\)? any later version"),
    ("gpl", "gnu.org", r"gnu\.org licenses gpl"),
    ("lgpl", "gnu.org", r"gnu\.org licenses lgpl"),
    ("agpl", "gnu.org", r"gnu\.org licenses agpl"),
    ("warranty-disclaimer", "warranty", r"without any warranty,? without even the implied warranty"),
    ("warranty-disclaimer", "as is", r"provided as is,? without warrant(?:y|ies)"),
    ("warranty-disclaimer", "as is", r"software is provided as is"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("bsl-1.0", "executable object", r"machine executable object code generated by a source language processor"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved"),
    ("copyright", "copyright", r"copyright (?:\(?c\)? )?(?:19|20)\d\d"),
    ("copyright", "copyright", r"copyright (?:\(?c\)? )?by"),
    ("copyright", "©", r"\xc2\xa9 ?(?:19|20)\d\d"),
    ("no-redistribution", "may not be", r"may not be (?:reproduced|copied|redistributed)(?: or (?:reproduced|copied|redistributed))?"),
    ("permission-required", "permission", r"without (?:the )?(?:prior |express )?(?:written )?permission of"),
    ("terms", "terms", r"subject to the terms and conditions of"),
    ("cc0-1.0", "waived", r"waived all copyright and related or neighbou?ring rights"),
    ("non-commercial", "commercial", r"(?:for )?non commercial (?:use|purposes) only"),
]


def _creative_commons() -> list[tuple[str, str | tuple[str, ...], str]]:
    """Label, keyword and regex of the Creative Commons licenses: each mix of elements by code, by version and by name."""
    out = [("cc0-1.0", ("cc0", "cc 0"), r"cc ?0(?: 1\.0)?"), ("cc0-1.0", "creative commons", r"creative commons (?:cc ?0|zero)"), ("cc", "creative commons", r"creative commons(?: public)? licen[sc]e")]
    long = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    for code in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        parts = code.split("-")
        name = f"creative commons {' '.join(long[p] for p in parts)}"
        out.append((f"cc-{code}", "cc", f"cc {' '.join(parts)}"))
        out.append((f"cc-{code}", "creative commons", name))
        out.append((f"cc-{code}", "creativecommons", rf"creativecommons\.org licenses {' '.join(parts)}"))
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", r"\.")
            out.append((f"cc-{code}-{version}", "cc", f"cc {' '.join(parts)} {number}"))
            out.append((f"cc-{code}-{version}", "creative commons", rf"{name}(?: \d?)?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?,? (?:version )?{number}"))
    return out


def _compiled(source: str) -> re.Pattern:
    source = source.replace(",? ", GAP).replace(" ?", f"(?:{GAP})?").replace(" ", GAP)
    return re.compile((r"(?<![0-9a-z\x80-\xff])" + source + r"(?![0-9a-z\x80-\xff])").encode("latin-1"), re.DOTALL)


def rules() -> list[Rule]:
    """All rules in order: identifiers first, then names with a version, names without, and wordings."""
    out = []
    creative = _creative_commons()
    labels = dict.fromkeys([*(label for label, _, _ in _NAMED), *(label for label, _, _ in creative)])
    for label in labels:
        tag = re.escape(label).replace(r"\-", "-")
        out.append((label, 0, 1.0, "spdx", rf"spdx license identifier {tag}(?:-only|-or-later)?".replace("-", "[-]")))
    for label, keyword, patterns in _NAMED:
        out += [(label, 1 if re.search(r"\d", label) else 2, 0.95 if re.search(r"\d", label) else 0.85, keyword, p) for p in patterns]
    out += [(label, 1 if re.search(r"\d\.\d", label) else 2, 0.95 if re.search(r"\d\.\d", label) else 0.85, keyword, p) for label, keyword, p in creative]
    out += [(label, 3, 0.6, keyword, p) for label, keyword, p in _WORDING]
    made = []
    for n, (label, priority, weight, keyword, source) in enumerate(out):
        # the single letter stands for the short names of the GNU licenses
        keywords = ("gpl", "general public") if keyword == "g" else ("cc by",) if keyword == "cc" else ("mit license", "mit licence", "the mit", "under mit", "mit no", "mit x11") if keyword == "mit" else ("isc license", "isc licence", "internet systems") if keyword == "isc" else keyword if isinstance(keyword, tuple) else (keyword,)
        made.append(Rule(f"{label}:{n}", label, priority, weight, keywords, _compiled(source)))
    return made
