"""Signature rules for license detection.

A rule is (label, kind, keyword, regex).  Regexes are written over a text's
lower-cased words joined by single spaces, and match whole words.  ``gates``
derives from every alternative of a regex a literal that each of its matches
has; one must occur in that text for the regex to be tried.  The keyword names
the subject only.  ``kind`` orders rules:
an identifier tag beats a full grant or notice, that beats a name, that beats
a bare mention.  Families with many versions come from templates.
"""

from __future__ import annotations

from re import _parser

#: kind -> (priority, confidence); a higher priority suppresses contained spans.
KINDS = {
    "tag": (5, 0.99),
    "grant": (4, 0.97),
    "notice": (3, 0.95),
    "url": (3, 0.93),
    "name": (2, 0.85),
    "mention": (1, 0.6),
}

Rule = tuple[str, str, str, str]


def _single() -> list[Rule]:
    return [
        # permissive
        ("mit", "grant", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        ("mit", "notice", "mit", r"(?:licensed|released|distributed|available) under the (?:terms of the )?mit license"),
        ("mit", "name", "mit", r"(?:the )?mit license"),
        ("mit", "name", "expat", r"expat license"),
        ("mit", "url", "opensource", r"opensource org licenses mit(?: license)?(?: php)?"),
        ("mit-0", "name", "attribution", r"mit no attribution(?: license)?"),
        ("x11", "name", "x11", r"x11 license"),
        ("isc", "grant", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("isc", "name", "isc", r"isc license"),
        ("0bsd", "name", "zero", r"(?:bsd zero clause|zero clause bsd) license"),
        ("bsd", "grant", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-3-clause", "grant", "neither", r"neither the name of (?:the )?(?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
        ("bsd-4-clause", "grant", "advertising", r"all advertising materials mentioning features or use of this software must display"),
        ("bsd-2-clause", "name", "bsd", r"(?:2 clause|two clause|simplified|freebsd) bsd license|bsd 2 clause(?: license)?"),
        ("bsd-3-clause", "name", "bsd", r"(?:3 clause|three clause|new|revised|modified) bsd license|bsd 3 clause(?: license)?"),
        ("bsd-4-clause", "name", "bsd", r"(?:4 clause|four clause|original|old) bsd license|bsd 4 clause(?: license)?"),
        ("bsd", "name", "bsd", r"bsd(?: style)? license"),
        ("zlib", "grant", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        ("zlib", "name", "zlib", r"zlib(?: libpng)? license"),
        ("libpng", "name", "libpng", r"libpng license"),
        ("unlicense", "grant", "unencumbered", r"this is free and unencumbered software released into the public domain"),
        ("unlicense", "name", "unlicense", r"the unlicense|unlicense org"),
        ("wtfpl", "name", "wtfpl", r"wtfpl"),
        ("wtfpl", "grant", "want", r"do what the fuck you want to public license"),
        ("public-domain", "grant", "domain", r"(?:dedicated|released|placed|hereby placed) (?:in|into|to) the public domain"),
        ("public-domain", "mention", "domain", r"public domain"),
        ("cc0-1.0", "grant", "cc0", r"cc0 1 0 universal"),
        ("cc0-1.0", "name", "cc0", r"cc0(?: license)?"),
        ("cc0-1.0", "url", "publicdomain", r"creativecommons org publicdomain zero 1 0"),
        ("blueoak-1.0.0", "name", "oak", r"blue oak model license"),
        ("curl", "name", "curl", r"curl license"),
        ("ntp", "name", "ntp", r"ntp license"),
        ("hpnd", "name", "historical", r"historical permission notice and disclaimer"),
        ("upl-1.0", "name", "universal", r"universal permissive license"),
        ("afl", "name", "academic", r"academic free license"),
        ("ecl-2.0", "name", "community", r"educational community license"),
        ("ncsa", "name", "ncsa", r"(?:university of illinois )?ncsa open source license"),
        ("postgresql", "name", "postgresql", r"postgresql license"),
        ("openssl", "name", "openssl", r"openssl license"),
        ("ssleay", "name", "ssleay", r"(?:original )?ssleay license"),
        ("python", "name", "python", r"python software foundation license|psf license"),
        ("ruby", "name", "ruby", r"ruby license"),
        ("php", "name", "php", r"php license"),
        ("zend", "name", "zend", r"zend (?:engine )?license"),
        ("vim", "name", "vim", r"vim license"),
        ("tcl", "name", "tcl", r"tcl tk license"),
        ("artistic", "name", "artistic", r"(?:the )?artistic license"),
        ("perl", "notice", "perl", r"under the same terms as perl itself"),
        ("w3c", "name", "w3c", r"w3c software (?:notice and )?license"),
        ("unicode", "name", "unicode", r"unicode license agreement"),
        ("icu", "name", "icu", r"icu license"),
        ("ijg", "name", "jpeg", r"independent jpeg group s software|ijg license"),
        ("freetype", "name", "freetype", r"freetype (?:project )?license"),
        ("beerware", "grant", "beer", r"(?:the )?beer ?ware license"),
        ("fair", "name", "fair", r"fair license"),
        ("naumen", "name", "naumen", r"naumen public license"),
        # weak and strong copyleft
        ("gpl", "grant", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("gpl", "name", "general", r"(?:gnu )?general public license"),
        ("gpl", "url", "gnu", r"gnu org licenses (?:old licenses )?gpl(?: \d(?: \d)?)?"),
        ("lgpl", "name", "general", r"(?:gnu )?(?:lesser|library) general public license"),
        ("lgpl", "url", "gnu", r"gnu org licenses (?:old licenses )?lgpl(?: \d(?: \d)?)?"),
        ("agpl", "name", "affero", r"(?:gnu )?affero general public license"),
        ("agpl", "url", "gnu", r"gnu org licenses agpl(?: \d(?: \d)?)?"),
        ("gfdl", "name", "documentation", r"gnu free documentation license"),
        ("gpl", "mention", "gpl", r"(?:gnu )?gpl"),
        ("lgpl", "mention", "lgpl", r"(?:gnu )?lgpl"),
        ("agpl", "mention", "agpl", r"(?:gnu )?agpl"),
        ("classpath-exception", "notice", "classpath", r"(?:as a special exception )?(?:the )?classpath exception"),
        ("mpl", "notice", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
        ("mpl", "name", "mozilla", r"mozilla public license"),
        ("epl", "name", "eclipse", r"eclipse public license"),
        ("edl", "name", "eclipse", r"eclipse distribution license"),
        ("cddl", "name", "cddl", r"cddl(?: license)?"),
        ("cddl", "name", "distribution", r"common development and distribution license"),
        ("cpl", "name", "common", r"common public license"),
        ("ipl", "name", "ibm", r"ibm public license"),
        ("osl", "name", "open", r"open software license"),
        ("eupl", "name", "european", r"european union public licen[cs]e"),
        ("cecill", "name", "cecill", r"cecill(?: [abc])?(?: license)?"),
        ("ms-pl", "name", "microsoft", r"microsoft public license"),
        ("ms-rl", "name", "microsoft", r"microsoft reciprocal license"),
        ("apsl", "name", "apple", r"apple public source license"),
        ("qpl", "name", "public", r"q public license"),
        ("sleepycat", "name", "sleepycat", r"sleepycat license"),
        ("rpl", "name", "reciprocal", r"reciprocal public license"),
        ("npl", "name", "netscape", r"netscape public license"),
        ("spl", "name", "sun", r"sun public license"),
        ("watcom", "name", "watcom", r"sybase open watcom public license"),
        ("odbl", "name", "database", r"open database license|odbl"),
        ("odc-by", "name", "commons", r"open data commons attribution license"),
        ("pddl", "name", "public", r"public domain dedication and license"),
        ("ofl", "name", "open", r"sil open font license|open font license"),
        ("bitstream-vera", "name", "bitstream", r"bitstream vera fonts? (?:copyright|license)"),
        # source-available and proprietary
        ("sspl", "name", "server", r"server side public license"),
        ("busl", "name", "business", r"business source license"),
        ("elastic", "name", "elastic", r"elastic license"),
        ("commons-clause", "name", "commons", r"commons clause"),
        ("polyform", "name", "polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial|internal use) license"),
        ("json", "grant", "evil", r"the software shall be used for good not evil"),
        ("rail", "name", "rail", r"(?:open|creative ml open|bigscience) rail(?: m| license)?"),
        ("llama", "name", "llama", r"llama \d(?: \d)? community license"),
        ("proprietary", "notice", "rights", r"all rights reserved"),
        ("proprietary", "notice", "confidential", r"proprietary and confidential"),
        ("proprietary", "notice", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
        # apache
        ("apache", "grant", "apache", r"licensed under the apache license version (?:1 0|1 1|2 0)(?: the license)?"),
        ("apache", "name", "apache", r"(?:the )?apache(?: software)? license"),
        ("apache", "mention", "asl", r"asl 2 0"),
        ("apache", "url", "apache", r"apache org licenses license(?: 2 0)?"),
    ]


def _versioned() -> list[Rule]:
    """Versioned names and identifier tags of the large families."""
    out: list[Rule] = []
    tag = "spdx license identifier "
    for family, words, key in (("gpl", "general public license", "general"), ("lgpl", "lesser general public license", "lesser"), ("agpl", "affero general public license", "affero")):
        for version in ("1", "2", "2.1", "3"):
            v = version.replace(".", " ") + (r"(?: 0)?" if "." not in version else "")
            base = f"{family}-{version if '.' in version else version + '.0'}"
            out += [
                (f"{base}-only", "tag", "spdx", f"{tag}{family} {v}(?: only)?"),
                (f"{base}-or-later", "tag", "spdx", f"{tag}{family} {v} or later"),
                (base, "notice", key, rf"(?:gnu )?{words}(?: \w+){{0,6}}? (?:version|v) ?{v}"),
                (f"{base}-or-later", "notice", key, rf"(?:gnu )?{words}(?: \w+){{0,12}}? (?:version|v) ?{v}(?: of the license)? or (?:at your option )?any later version"),
                (base, "name", family, rf"{family}(?: version)? ?v?{v}"),
            ]
    for part in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        long = part.replace("by", "attribution").replace("sa", "share ?alike").replace("nc", "non ?commercial").replace("nd", "no ?deriv(?:ative)?s?(?: works)?")
        label = "cc-" + part.replace(" ", "-")
        out.append((label, "name", "creative", rf"creative commons {long}(?: license)?"))
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = version.replace(".", " ")
            out += [
                (f"{label}-{version}", "tag", "spdx", f"{tag}cc {part} {v}"),
                (f"{label}-{version}", "notice", "creative", rf"creative commons {long}(?: license)? {v}(?: international| unported| generic)?"),
                (f"{label}-{version}", "url", "creativecommons", f"creativecommons org licenses {part} {v}"),
                (f"{label}-{version}", "name", "cc", f"cc {part} {v}"),
            ]
    plain = [
        ("apache", ("1.0", "1.1", "2.0"), "apache", r"apache(?: software)? license(?: version)?"),
        ("mpl", ("1.0", "1.1", "2.0"), "mozilla", r"mozilla public license(?: version| v)?"),
        ("epl", ("1.0", "2.0"), "eclipse", r"eclipse public license(?: version| v)?"),
        ("artistic", ("1.0", "2.0"), "artistic", r"artistic license(?: version)?"),
        ("afl", ("1.1", "1.2", "2.0", "2.1", "3.0"), "academic", r"academic free license(?: version| v)?"),
        ("osl", ("1.0", "1.1", "2.0", "2.1", "3.0"), "open", r"open software license(?: version| v)?"),
        ("eupl", ("1.0", "1.1", "1.2"), "european", r"european union public licen[cs]e(?: version| v)?"),
        ("cddl", ("1.0", "1.1"), "distribution", r"common development and distribution license(?: version| v)?"),
        ("cecill", ("1.0", "1.1", "2.0", "2.1"), "cecill", r"cecill(?: license)?(?: version| v)?"),
        ("lppl", ("1.0", "1.1", "1.2", "1.3"), "latex", r"latex project public license(?: version| v)?"),
        ("zpl", ("1.1", "2.0", "2.1"), "zope", r"zope public license(?: version| v)?"),
        ("ofl", ("1.0", "1.1"), "open", r"sil open font license(?: version)?"),
        ("php", ("3.0", "3.01"), "php", r"php license(?: version)?"),
        ("gfdl", ("1.1", "1.2", "1.3"), "documentation", r"gnu free documentation license(?: version)?"),
        ("apsl", ("1.0", "1.1", "1.2", "2.0"), "apple", r"apple public source license(?: version)?"),
        ("bsl", ("1.0",), "boost", r"boost software license(?: version)?"),
        ("elastic", ("1.0", "2.0"), "elastic", r"elastic license(?: version| v)?"),
        ("busl", ("1.1",), "business", r"business source license(?: version)?"),
    ]
    for family, versions, key, words in plain:
        for version in versions:
            v = version.replace(".", " ")
            out += [
                (f"{family}-{version}", "tag", "spdx", f"{tag}{family} {v}"),
                (f"{family}-{version}", "notice", key, f"{words} {v}"),
            ]
    for name in ("mit", "isc", "0bsd", "zlib", "unlicense", "wtfpl", "cc0 1 0", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "postgresql", "openssl", "ncsa", "curl", "x11", "ms pl", "ms rl", "odbl 1 0", "upl 1 0", "blueoak 1 0 0"):
        label = "cc0-1.0" if name.startswith("cc0") else name.replace(" 1 0 0", "-1.0.0").replace(" 1 0", "-1.0").replace(" ", "-")
        out.append((label, "tag", "spdx", tag + name))
    return out


def rules() -> list[Rule]:
    return _single() + _versioned()


def _branches(items: list) -> list[tuple[str, bool]]:
    """(longest literal run, whether the whole match is it) of every alternative of a parsed regex."""
    found = [("", "", True)]  # longest run so far, run at the end, nothing but literals so far
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            found = [(best, tail + chr(value), whole) for best, tail, whole in found]
            continue
        if name == "SUBPATTERN":
            parts = _branches(list(value[3]))
        elif name == "BRANCH":
            parts = [x for branch in value[1] for x in _branches(list(branch))]
        else:  # a repeat, a class: may be anything
            parts = [("", False)]
        found = [
            (best, tail + run, whole) if exact else (max(best, tail, run, key=len), "", False)
            for best, tail, whole in found
            for run, exact in parts
        ]
    return [(max(best, tail, key=len), whole) for best, tail, whole in found]


def gates(pattern: str) -> list[str]:
    """For each alternative of a rule the longest literal that all its matches have."""
    return sorted({run for run, _ in _branches(list(_parser.parse(pattern)))})
