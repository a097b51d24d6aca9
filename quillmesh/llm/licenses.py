"""License scans: ordered signature rules over the words of a text, with priorities and interval containment."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licenses: label, the words of its identifier, and what its name looks like. Texts are lower-case words with one
#: space between; VERSION stands for an optional "version" or "v".
VERSION = "(?:version |v )?"
LICENSES = [
    ("apache-1.0", "apache 1 0", f"apache (?:software )?licen[cs]e {VERSION}1 0"),
    ("apache-1.1", "apache 1 1", f"apache (?:software )?licen[cs]e {VERSION}1 1"),
    ("apache-2.0", "apache 2 0", f"apache (?:software )?licen[cs]e {VERSION}2(?: 0)?"),
    ("mit", "mit", "(?:mit|expat) licen[cs]e"),
    ("mit-0", "mit 0", "mit no attribution licen[cs]e"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("isc", "isc", "isc licen[cs]e"),
    ("0bsd", "0bsd", "(?:0bsd|zero clause bsd|bsd zero clause) licen[cs]e"),
    ("bsd-2-clause", "bsd 2 clause", "(?:simplified|freebsd|(?:bsd )?(?:2|two) clause(?: bsd)?) licen[cs]e"),
    ("bsd-3-clause", "bsd 3 clause", "(?:new bsd|revised bsd|modified bsd|(?:bsd )?(?:3|three) clause(?: bsd)?) licen[cs]e"),
    ("bsd-4-clause", "bsd 4 clause", "(?:original bsd|(?:bsd )?(?:4|four) clause(?: bsd)?) licen[cs]e"),
    ("gpl-1.0", "gpl 1 0", f"(?:gnu )?(?:general public licen[cs]e|gpl) {VERSION}1(?: 0)?"),
    ("gpl-2.0", "gpl 2 0", f"(?:gnu )?(?:general public licen[cs]e|gpl) {VERSION}2(?: 0)?"),
    ("gpl-2.0-or-later", "gpl 2 0 or later", f"(?:gnu )?(?:general public licen[cs]e|gpl) {VERSION}2(?: 0)? or (?:at your option )?(?:any )?later"),
    ("gpl-3.0", "gpl 3 0", f"(?:gnu )?(?:general public licen[cs]e|gpl) {VERSION}3(?: 0)?"),
    ("gpl-3.0-or-later", "gpl 3 0 or later", f"(?:gnu )?(?:general public licen[cs]e|gpl) {VERSION}3(?: 0)? or (?:at your option )?(?:any )?later"),
    ("lgpl-2.0", "lgpl 2 0", f"(?:gnu )?(?:library|lesser) (?:general public licen[cs]e|gpl) {VERSION}2(?: 0)?"),
    ("lgpl-2.1", "lgpl 2 1", f"(?:gnu )?(?:lesser general public licen[cs]e|lgpl) {VERSION}2 1"),
    ("lgpl-3.0", "lgpl 3 0", f"(?:gnu )?(?:lesser general public licen[cs]e|lgpl) {VERSION}3(?: 0)?"),
    ("agpl-3.0", "agpl 3 0", f"(?:gnu )?(?:affero general public licen[cs]e|agpl) {VERSION}3(?: 0)?"),
    ("gfdl-1.2", "gfdl 1 2", f"(?:gnu )?free documentation licen[cs]e {VERSION}1 2"),
    ("gfdl-1.3", "gfdl 1 3", f"(?:gnu )?free documentation licen[cs]e {VERSION}1 3"),
    ("mpl-1.0", "mpl 1 0", f"mozilla public licen[cs]e {VERSION}1 0"),
    ("mpl-1.1", "mpl 1 1", f"mozilla public licen[cs]e {VERSION}1 1"),
    ("mpl-2.0", "mpl 2 0", f"mozilla public licen[cs]e {VERSION}2(?: 0)?"),
    ("epl-1.0", "epl 1 0", f"eclipse public licen[cs]e {VERSION}1(?: 0)?"),
    ("epl-2.0", "epl 2 0", f"eclipse public licen[cs]e {VERSION}2(?: 0)?"),
    ("cddl-1.0", "cddl 1 0", f"common development and distribution licen[cs]e {VERSION}1 0"),
    ("cddl-1.1", "cddl 1 1", f"common development and distribution licen[cs]e {VERSION}1 1"),
    ("cpl-1.0", "cpl 1 0", f"common public licen[cs]e {VERSION}1 0"),
    ("ibm-pl-1.0", "ipl 1 0", f"ibm public licen[cs]e {VERSION}1 0"),
    ("eupl-1.1", "eupl 1 1", f"european union public licen[cs]e {VERSION}1 1"),
    ("eupl-1.2", "eupl 1 2", f"european union public licen[cs]e {VERSION}1 2"),
    ("artistic-1.0", "artistic 1 0", f"artistic licen[cs]e {VERSION}1 0"),
    ("artistic-2.0", "artistic 2 0", f"artistic licen[cs]e {VERSION}2(?: 0)?"),
    ("bsl-1.0", "bsl 1 0", f"boost software licen[cs]e {VERSION}1 0"),
    ("busl-1.1", "busl 1 1", f"business source licen[cs]e {VERSION}1 1"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", "the unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public licen[cs]e"),
    ("cc0-1.0", "cc0 1 0", "(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)? licen[cs]e"),
    ("cc-by-2.0", "cc by 2 0", "creative commons attribution 2 0(?: generic)?(?: licen[cs]e)?"),
    ("cc-by-2.5", "cc by 2 5", "creative commons attribution 2 5(?: generic)?(?: licen[cs]e)?"),
    ("cc-by-3.0", "cc by 3 0", "creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-4.0", "cc by 4 0", "creative commons attribution 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "creative commons attribution share ?alike 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "creative commons attribution non ?commercial 3 0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "creative commons attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)?"),
    ("ofl-1.1", "ofl 1 1", f"sil open font licen[cs]e {VERSION}1 1"),
    ("odbl-1.0", "odbl 1 0", f"open database licen[cs]e {VERSION}1 0"),
    ("odc-by-1.0", "odc by 1 0", f"open data commons attribution licen[cs]e {VERSION}1 0"),
    ("python-2.0", "python 2 0", f"python software foundation licen[cs]e {VERSION}2"),
    ("php-3.01", "php 3 01", f"php licen[cs]e {VERSION}3 01"),
    ("ruby", "ruby", "ruby licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("ncsa", "ncsa", "university of illinois ncsa open source licen[cs]e"),
    ("afl-3.0", "afl 3 0", f"academic free licen[cs]e {VERSION}3 0"),
    ("osl-3.0", "osl 3 0", f"open software licen[cs]e {VERSION}3 0"),
    ("ms-pl", "ms pl", "microsoft public licen[cs]e"),
    ("ms-rl", "ms rl", "microsoft reciprocal licen[cs]e"),
    ("sspl-1.0", "sspl 1 0", f"server side public licen[cs]e {VERSION}1"),
    ("elastic-2.0", "elastic 2 0", f"elastic licen[cs]e {VERSION}2(?: 0)?"),
    ("blueoak-1.0.0", "blueoak 1 0 0", "blue oak model licen[cs]e 1 0 0"),
]
#: Rules that stand alone, in notices, headers, clauses and exceptions: label, priority, confidence, keyword, pattern.
LONE = [
    # notices of rights
    ("copyright", 10, 0.4, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", 10, 0.3, "copyright", "copyright (?:c )?by [^ ]+"),
    ("public-domain", 20, 0.8, "public domain", "(?:dedicated to|released (?:in)?to|placed in) the public domain"),
    ("public-domain", 20, 0.7, "public domain", "this (?:work|file|code|software|document) is in the public domain"),
    ("public-domain", 20, 0.7, "copyright", "no (?:known )?copyright restrictions"),
    ("public-domain", 20, 0.8, "copyright", "the authors? (?:hereby )?disclaims? copyright to this source code"),
    ("proprietary", 20, 0.6, "proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 20, 0.6, "copying", "unauthorized (?:copying|reproduction or copying) of this (?:file|program|software|document)"),
    ("proprietary", 20, 0.5, "proprietary", "(?:contains|is) proprietary (?:and confidential )?information"),
    ("proprietary", 20, 0.5, "trade secret", "(?:valuable )?trade secrets? of [^ ]+"),
    ("trial", 15, 0.5, "licen", "(?:evaluation|trial) licen[cs]e"),
    ("eula", 20, 0.6, "licen", "end user licen[cs]e agreement"),
    ("license-agreement", 10, 0.4, "licen", "software licen[cs]e agreement"),
    ("license-notice", 10, 0.3, "licen", "(?:licensed|released|distributed|available) under (?:the |a |an )?(?:terms of the )?[^ ]+ licen[cs]e"),
    ("license-reference", 10, 0.4, "licen", "see (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying)(?: txt| md)?(?: file)? for (?:more |further )?(?:details|information|terms)"),
    ("license-reference", 10, 0.4, "licen", "(?:found|included) in the licen[cs]e file"),
    ("license-reference", 10, 0.4, "copying", "you should have received a copy of (?:the )?(?:licen[cs]e|copying)"),
    ("dual-license", 20, 0.6, "licen", "dual(?:ly)? licensed"),
    ("dual-license", 20, 0.6, "licen", "(?:may|can) be (?:used|distributed) under (?:the terms of )?either"),
    ("non-commercial", 20, 0.6, "commercial", "for non ?commercial (?:use|purposes)(?: only)?"),
    ("no-derivatives", 20, 0.5, "derivative", "no derivative works"),
    ("attribution", 15, 0.5, "attribution", "attribution (?:is )?required"),
    # families whose version is not given
    ("gpl", 20, 0.7, "general public licen", "gnu (?:lesser |library |affero )?general public licen[cs]e"),
    ("bsd", 20, 0.6, "bsd licen", "bsd licen[cs]e"),
    ("bsd", 20, 0.5, "licen", "bsd style licen[cs]e"),
    ("apache", 20, 0.6, "apache licen", "apache licen[cs]e"),
    ("mpl", 20, 0.6, "mozilla public licen", "mozilla public licen[cs]e"),
    ("epl", 20, 0.6, "eclipse public licen", "eclipse public licen[cs]e"),
    ("artistic", 20, 0.6, "artistic licen", "artistic licen[cs]e"),
    ("creative-commons", 20, 0.5, "creative commons", "creative commons (?:attribution|licen[cs]e|deed|share ?alike|non ?commercial)"),
    ("gfdl", 20, 0.6, "free documentation licen", "gnu free documentation licen[cs]e"),
    ("perl", 25, 0.7, "perl", "under the same (?:terms|licen[cs]e) as perl(?: itself)?"),
    # header texts
    ("mit", 45, 0.9, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", 45, 0.85, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 45, 0.7, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", 45, 0.8, "permission", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose"),
    ("ofl", 45, 0.8, "permission", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("bsl-1.0", 45, 0.85, "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsd", 45, 0.8, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2.0", 45, 0.95, "apache licen", "licensed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", 45, 0.9, "general public licen", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", 45, 0.9, "general public licen", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", 45, 0.9, "general public licen", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", 30, 0.8, "general public licen", "you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[cs]e along with"),
    ("mpl-2.0", 45, 0.95, "mozilla public licen", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", 45, 0.95, "mozilla public licen", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl-2.0", 45, 0.95, "eclipse public licen", "made available under the terms of the eclipse public licen[cs]e (?:v |version )?2 0"),
    ("epl-1.0", 45, 0.95, "eclipse public licen", "made available under the terms of the eclipse public licen[cs]e (?:v |version )?1 0"),
    ("cddl-1.0", 45, 0.9, "common development", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("unlicense", 45, 0.9, "public domain", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", 45, 0.9, "copyright", "has waived all copyright and related (?:or neighboring )?rights"),
    ("zlib", 45, 0.85, "permission", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("wtfpl", 45, 0.9, "copying", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("python-2.0", 40, 0.8, "licen", "psf licen[cs]e agreement for python"),
    ("json", 45, 0.9, "good", "the software shall be used for good not evil"),
    ("beerware", 45, 0.9, "licen", "the beer ?ware licen[cs]e"),
    ("ms-pl", 40, 0.8, "microsoft", "microsoft public licen[cs]e ms pl"),
    ("oracle-binary", 40, 0.8, "licen", "oracle binary code licen[cs]e agreement"),
    ("sun-bcl", 40, 0.8, "licen", "sun microsystems inc binary code licen[cs]e agreement"),
    ("cecill", 30, 0.8, "cecill", "cecill(?: [abc])?(?: free software)? licen[cs]e(?: agreement)?"),
    ("mulan", 30, 0.8, "licen", "mulan p(?:ermissive software|sl) licen[cs]e"),
    ("openldap", 30, 0.8, "licen", "openldap public licen[cs]e"),
    ("qpl", 30, 0.8, "licen", "q public licen[cs]e"),
    ("sleepycat", 30, 0.8, "licen", "sleepycat licen[cs]e"),
    ("vim", 30, 0.8, "licen", "vim licen[cs]e"),
    ("curl", 30, 0.8, "licen", "curl licen[cs]e"),
    ("libpng", 30, 0.8, "licen", "libpng licen[cs]e"),
    ("ijg", 30, 0.8, "independent jpeg", "based in part on the work of the independent jpeg group"),
    ("zope", 30, 0.8, "licen", "zope public licen[cs]e"),
    ("w3c", 30, 0.8, "licen", "w3c software (?:and document )?(?:notice and )?licen[cs]e"),
    ("unicode", 30, 0.8, "licen", "unicode (?:inc )?licen[cs]e agreement"),
    ("ubuntu-font", 30, 0.8, "licen", "ubuntu font licen[cs]e"),
    ("polyform", 30, 0.8, "licen", "polyform (?:noncommercial|shield|strict|small business|internal use|perimeter) licen[cs]e"),
    ("commons-clause", 35, 0.8, "commons clause", "commons clause(?: licen[cs]e)? condition"),
    ("hippocratic", 30, 0.8, "licen", "hippocratic licen[cs]e"),
    ("parity", 30, 0.8, "licen", "parity public licen[cs]e"),
    ("llama", 30, 0.8, "licen", "llama (?:2 |3 )?community licen[cs]e"),
    ("openrail", 30, 0.8, "licen", "(?:creativeml |bigscience )?open ?rail(?: m)? licen[cs]e"),
    ("etalab", 30, 0.8, "licen", "(?:etalab )?licen[cs]e ouverte"),
    ("ogl-uk", 30, 0.8, "licen", "open government licen[cs]e"),
    ("pddl", 30, 0.8, "licen", "public domain dedication and licen[cs]e"),
    # exceptions
    ("classpath-exception", 50, 0.9, "permission", "give you permission to link this library with independent modules to produce an executable"),
    ("classpath-exception", 50, 0.9, "exception", "classpath exception(?: 2 0)?"),
    ("llvm-exception", 50, 0.9, "exception", "llvm exceptions?"),
    ("gcc-exception", 50, 0.9, "exception", "gcc runtime library exception"),
    ("bison-exception", 50, 0.9, "exception", "bison exception(?: 2 2)?"),
    ("autoconf-exception", 50, 0.9, "exception", "autoconf exception(?: [23] 0)?"),
    ("font-exception", 50, 0.9, "exception", "(?:font embedding|font) exception(?: 2 0)?"),
    ("linking-exception", 50, 0.8, "exception", "(?:static|dynamic)? ?linking exception"),
    ("openssl-exception", 50, 0.8, "openssl", "permission to link (?:the code of )?(?:portions of )?this program with the openssl library"),
    ("syscall-note", 50, 0.9, "syscall", "linux syscall note"),
    ("universal-foss-exception", 50, 0.8, "exception", "universal foss exception"),
    # clauses
    ("redistribution-notice", 15, 0.6, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("redistribution-clause", 15, 0.5, "redistribution", "redistributions of source code must retain the above copyright notice"),
    ("redistribution-clause", 15, 0.5, "redistribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("permission-notice", 15, 0.6, "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("notice-clause", 15, 0.5, "copyright", "the above copyright notice and this permission notice shall be included in all copies"),
    ("no-endorsement-clause", 15, 0.5, "endorse", "may be used to endorse or promote products derived from this software"),
    ("advertising-clause", 15, 0.6, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("warranty-disclaimer", 10, 0.4, "warrant", "without warrant(?:y|ies) of any kind"),
    ("warranty-disclaimer", 10, 0.4, "warrant", "without any warranty"),
    ("warranty-disclaimer", 10, 0.4, "warrant", "without warrant(?:y|ies) or conditions of any kind"),
    ("warranty-disclaimer", 10, 0.4, "warrant", "implied warrant(?:y|ies) of merchantability"),
    ("warranty-disclaimer", 10, 0.4, "warrant", "the software is provided as is without warranty"),
    ("liability-disclaimer", 10, 0.4, "liab", "in no event shall the (?:authors?|copyright holders?|regents|contributors?)(?: [^ ]+){0,6} be liable"),
    ("patent-grant", 15, 0.5, "patent", "(?:perpetual worldwide non exclusive|worldwide non exclusive)(?: [^ ]+){0,4} patent licen[cs]e"),
    ("trademark-clause", 10, 0.4, "trademark", "does not grant permission to use the trade names trademarks service marks"),
    ("contributor-agreement", 15, 0.5, "licen", "contributor licen[cs]e agreement"),
    ("source-offer", 15, 0.5, "source code", "written offer(?: valid for at least three years)? to (?:give|provide)(?: [^ ]+){0,12} source code"),
]


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, pattern) in their order; a rule runs on texts that hold its keyword."""
    out = []
    for label, words, name in LICENSES:
        first = re.match("[a-z]+(?= )", name)
        named = first[0] if first else " " if "|gpl" in name or "|lgpl" in name or "|agpl" in name else "licen"
        out.append((label, 50, 1.0, "spdx", f"spdx licen[cs]e identifier {words}(?: only)?"))
        out.append((label, 40, 0.95, named, f"(?:licensed|released|distributed|published|provided|available|covered|governed) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}"))
        out.append((label, 30, 0.85, named, name))
        out.append((label, 25, 0.8, words.split()[0], f"licen[cs]e[sd]? {words}"))
    return out + LONE


#: A text without any of these passes no rule's keyword.
GATE = [
    "licen", "gpl", "spdx", "creative commons", "copyright", "public domain", "proprietary", "warrant", "redistribution", "permission", "copying",
    "trade secret", "commercial", "derivative", "attribution", "perl", "common development", "good", "microsoft", "cecill", "independent jpeg",
    "commons clause", "exception", "openssl", "syscall", "endorse", "advertising", "liab", "patent", "trademark", "source code",
]
SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Priorities of the rules, and a span in the order of the sweep.
LEVELS = sorted({rule[1] for rule in rules()})
SPAN = "struct<start: bigint, below: bigint, rank: int, rule: int>"


def blocks(xs: str) -> str:
    """An array cut into runs of about the square root of its size."""
    size = f"greatest(1, cast(ceil(sqrt(size({xs}))) as int))"
    return f"transform(sequence(0, (size({xs}) - 1) div {size}), i -> slice({xs}, i * {size} + 1, {size}))"


def spans(rule: str, number: str) -> str:
    """The spans of a rule in words. Each begins after all gaps and hits before it: sums over blocks, then inside each,
    so that no list longer than a block grows by one again and again."""
    parts = f"zip_with(split(words, {rule}.pattern), regexp_extract_all(words, {rule}.pattern, 0), (g, h) -> struct(length(g) as gap, length(h) as hit))"
    step = f"""(s, x) -> if(x.hit is null, s, named_struct('at', s.at + x.gap + x.hit, 'out', array_append(s.out,
      named_struct('start', s.at + x.gap, 'below', -(s.at + x.gap + x.hit), 'rank', -{rule}.priority, 'rule', {number}))))"""
    total = "aggregate(ys, 0L, (t, y) -> t + coalesce(y.gap, 0) + coalesce(y.hit, 0))"
    starts = f"aggregate(cut, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (s, ys) -> named_struct('at', s.at + {total}, 'out', array_append(s.out, s.at)), s -> s.out)"
    inside = f"aggregate(ys, named_struct('at', begin, 'out', cast(array() as array<{SPAN}>)), {step}, s -> s.out)"
    return f"flatten(flatten(transform(array({parts}), xs -> transform(array({blocks('xs')}), cut -> flatten(zip_with(cut, {starts}, (ys, begin) -> {inside}))))))"


def undominated(every: str) -> str:
    """The spans of a list that none of higher priority contains, nor one of the same that is longer, or equal and of an
    earlier rule.

    Sorted by start, then the longer, the higher priority, the earlier rule, what dominates a span stands before it:
    a span stays if no end so far of its priority or a higher one reaches its own. One pass, by blocks as in spans().
    """
    names = [f"m{level}" for level in LEVELS]
    ends = lambda ys, level: f"coalesce(array_max(transform(filter({ys}, y -> y.rank <= -{level}), y -> -y.below)), -1L)"
    fields = lambda of: ", ".join(f"'{n}', {of(n, level)}" for n, level in zip(names, LEVELS, strict=True))
    empty, kind = fields(lambda n, _: "-1L"), "struct<" + ", ".join(f"{n}: bigint" for n in names) + ">"
    tops = f"named_struct({fields(lambda n, level: f'greatest(s.{n}, {ends('ys', level)})')}, 'out', array_append(s.out, named_struct({fields(lambda n, _: f's.{n}')})))"
    before = f"aggregate(cut, named_struct({empty}, 'out', cast(array() as array<{kind}>)), (s, ys) -> {tops}, s -> s.out)"
    held = "case x.rank " + " ".join(f"when -{level} then s.{n}" for n, level in zip(names, LEVELS, strict=True)) + " end"
    step = f"(s, x) -> named_struct({fields(lambda n, level: f'if(x.rank <= -{level}, greatest(s.{n}, -x.below), s.{n})')}, 'out', if({held} >= -x.below, s.out, array_append(s.out, x)))"
    inside = f"aggregate(ys, named_struct({fields(lambda n, _: f'top.{n}')}, 'out', cast(array() as array<{SPAN}>)), {step}, s -> s.out)"
    return f"flatten(flatten(transform(array(array_sort({every})), xs -> transform(array({blocks('xs')}), cut -> flatten(zip_with(cut, {before}, (ys, top) -> {inside}))))))"


def detections(docs: DataFrame) -> DataFrame:
    """docs as the struct row, n_words, and found: spans of label, confidence, priority, start and end (characters of
    the words with one space between), without those that a span of higher priority contains, or one of the same that
    is longer or, if equal, of an earlier rule; spans that overlap in part both stay. base has for each phrase n,
    first and last (word numbers).

    All is done row by row, without a shuffle: nulls count as empty texts, repeated rows and null ids are kept, other
    columns stay in row. A very long text with many hits takes sorted passes, no pairs of hits.
    """
    listed = rules()
    table_of_rules = ", ".join(f"struct({quoted(label)} as label, {priority} as priority, {score}D as confidence, {quoted(key)} as key, {quoted(f'(?<= ){p}(?= )')} as pattern, {i} as rule)" for i, (label, priority, score, key, p) in enumerate(listed))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.selectExpr("row", f"concat(' ', trim(regexp_replace(translate(text, '{upper}', '{lower}'), '{SEPARATORS}', ' ')), ' ') as words")
    df = df.selectExpr("*", "case when words = '  ' then 0L else cast(length(words) - length(translate(words, ' ', '')) - 1 as bigint) end as n_words")
    base = []
    for phrase, label in PHRASES.items():
        key, size = f"' {phrase} '", len(phrase.split())
        count = f"length(replace(words, ' ', '  ')) - length(replace(replace(words, ' ', '  '), ' {phrase.replace(' ', '  ')} ', ''))"
        spaces = lambda part: f"(length({part}) - length(translate({part}, ' ', '')))"
        first, last = spaces(f"substring_index(words, {key}, 1)"), f"n_words - {size} - {spaces(f'substring_index(words, {key}, -1)')}"
        some = f"struct('{label}' as label, cast(({count}) / {len(phrase) + size + 1} as bigint) as n, cast({first} as bigint) as first, cast({last} as bigint) as last)"
        base.append(f"case when contains(words, {key}) then {some} end")
    df = df.selectExpr("*", f"array_compact(array({', '.join(base)})) as base")
    gate = " or ".join(f"contains(words, '{g}')" for g in GATE)
    every = f"flatten(transform(filter(array({table_of_rules}), r -> contains(words, r.key)), r -> {spans('r', 'r.rule')}))"
    df = df.selectExpr("row", "n_words", "base", f"case when {gate} then {every} else cast(array() as array<{SPAN}>) end as every")
    df = df.selectExpr("row", "n_words", "base", f"case when size(every) > 1 then {undominated('every')} else every end as kept")
    labels = ", ".join(f"struct({quoted(label)} as label, {score}D as confidence)" for label, _, score, _, _ in listed)
    span = "named_struct('label', r[x.rule].label, 'confidence', r[x.rule].confidence, 'priority', -x.rank, 'start', x.start, 'end', -x.below)"
    return df.selectExpr("row", "n_words", "base", f"flatten(transform(array(array({labels})), r -> transform(kept, x -> {span}))) as found")


def licenses(docs: DataFrame) -> DataFrame:
    """row, n_words, n_base, first_word, last_word, base_labels, labels, score, found for each row of docs.

    score is the highest confidence of what was found: that of the rule, 0.7 for the base phrases cc by and general
    public license, 0.5 for all rights reserved, else 0. See detections() for the cases of nulls and repeats.
    """
    sure = "case b.label when 'reserved' then 0.5D else 0.7D end"
    return detections(docs).selectExpr(
        "row", "n_words",
        "aggregate(base, 0L, (s, b) -> s + b.n) as n_base",
        "array_min(base.first) as first_word", "array_max(base.last) as last_word",
        "array_sort(array_distinct(base.label)) as base_labels",
        "array_sort(array_distinct(concat(base.label, found.label))) as labels",
        f"coalesce(array_max(concat(found.confidence, transform(base, b -> {sure}))), 0D) as score",
        "found",
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base places and labels of every document."""
    return licenses(table(spark, sf_dir, "documents")).selectExpr(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", "array_join(base_labels, ',') as base_labels", "array_join(labels, ',') as labels", "score"
    )
