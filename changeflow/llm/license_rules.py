"""Signature rules of the license scan.

Patterns match normalised text: lower-cased words with single blanks, so
"GPL-3.0" reads "gpl 3 0".  A rule is tried only on texts that hold its
keyword, a word that every match of the pattern contains.  Each license of
NAMES is looked for by the frames of FRAMES, each further signature of TEXTS
as it stands.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    order: int        # ties go to the earlier rule
    priority: int     # 0 is strongest
    keyword: str
    pattern: str
    label: str
    confidence: float
    base: bool        # one of the phrases that are always reported


# phrase, label, keyword: reported wherever their words stand consecutively
BASE = [
    ("gnu general public license", "gpl", "gnu"),
    ("apache license", "apache", "apache"),
    ("cc by", "cc-by", "cc"),
    ("mit license", "mit", "mit"),
]

# label, keyword, pattern of the name
NAMES = [
    ("gpl-1.0", "general", r"gnu general public licen[cs]e (?:version|v) ?1(?: 0)?"),
    ("gpl-2.0", "general", r"gnu general public licen[cs]e (?:as published by the free software foundation )?(?:version|v) ?2(?: 0)?"),
    ("gpl-3.0", "general", r"gnu general public licen[cs]e (?:as published by the free software foundation )?(?:version|v) ?3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl (?:version |v )?3(?: 0)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3"),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e"),
    ("lgpl-2.0", "library", r"gnu library general public licen[cs]e(?: version 2(?: 0)?)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e (?:version|v) ?2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e (?:version|v) ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"lgpl (?:version |v )?2 1"),
    ("lgpl-3.0", "lgpl", r"lgpl (?:version |v )?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e (?:version|v) ?3(?: 0)?"),
    ("agpl-3.0", "agpl", r"agpl (?:version |v )?3(?: 0)?"),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e(?: version 1 [123])?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version|v) ?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?(?: licen[cs]e)?"),
    ("mit", "mit", r"(?:the )?mit licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit-0", "mit", r"mit (?:no attribution|0)(?: licen[cs]e)?"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd(?: licen[cs]e)?"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[cs]e)?"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?"),
    ("boost-1.0", "boost", r"boost software licen[cs]e(?: version 1 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("mpl-2.0", "mpl", r"mpl (?:version |v )?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v )?1 0)?"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e(?: (?:version |v )?1 0)?"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?: (?:version |v )?1 0)?"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: (?:version |v )?1 0)?"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:version |v )?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v )?2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: (?:version |v )?1 [12])?"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: (?:version )?[12](?: [01])?)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("osl-3.0", "open", r"open software licen[cs]e(?: (?:version |v )?3(?: 0)?)?"),
    ("afl-3.0", "academic", r"academic free licen[cs]e(?: (?:version |v )?3(?: 0)?)?"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: version 2 0)?"),
    ("psf-2.0", "python", r"python software foundation licen[cs]e(?: version 2)?"),
    ("php-3.01", "php", r"php licen[cs]e(?: version 3(?: 0)?1?)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: (?:version |v )?1 0)?"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e"),
    ("unicode-dfs", "unicode", r"unicode licen[cs]e agreement"),
    ("qpl-1.0", "q", r"q public licen[cs]e(?: version 1 0)?"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "want", r"do what the fuck you want to public licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("beerware", "beerware", r"beerware(?: licen[cs]e)?"),
    ("bsl-1.1", "business", r"business source licen[cs]e(?: (?:version )?1 1)?"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: (?:version |v )?1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: 2 0)?"),
    ("commons-clause", "commons", r"commons clause(?: licen[cs]e condition)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: (?:version )?1 1)?"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[cs]e(?: (?:version |v )?1 0)?"),
    ("odc-by-1.0", "commons", r"open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?"),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[cs]e"),
    ("cdla-permissive", "cdla", r"cdla permissive(?: [12] 0)?"),
    ("cdla-sharing", "cdla", r"cdla sharing(?: 1 0)?"),
    ("ogl-uk", "government", r"open government licen[cs]e(?: (?:version |v )?[123] 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0-1.0", "zero", r"creative commons zero(?: (?:version |v )?1 0)?"),
    ("cc-by-4.0", "cc", r"cc by 4 0"),
    ("cc-by-3.0", "cc", r"cc by 3 0"),
    ("cc-by-2.0", "cc", r"cc by 2 [05]"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3 0"),
    ("cc-by-nd-4.0", "cc", r"cc by nd 4 0"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0"),
    ("cc-by-nc-3.0", "cc", r"cc by nc 3 0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa 4 0"),
    ("cc-by-nc-sa-3.0", "cc", r"cc by nc sa 3 0"),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd 4 0"),
    ("cc-by-sa", "cc", r"cc by sa"),
    ("cc-by-nd", "cc", r"cc by nd"),
    ("cc-by-nc", "cc", r"cc by nc"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd"),
    ("cc-by-4.0", "attribution", r"creative commons attribution 4 0(?: international)?"),
    ("cc-by-3.0", "attribution", r"creative commons attribution 3 0(?: unported)?"),
    ("cc-by-sa", "attribution", r"creative commons attribution share ?alike"),
    ("cc-by-nc", "attribution", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "attribution", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by", "attribution", r"creative commons attribution"),
    ("cc", "creative", r"creative commons(?: public)? licen[cs]e"),
    ("fair", "fair", r"fair licen[cs]e"),
    ("ncl", "naumen", r"naumen public licen[cs]e"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:permissive software licen[cs]e|psl)(?: v?2)?"),
    ("openrail", "openrail", r"openrail(?: m)?(?: licen[cs]e)?"),
    ("blueoak-1.0", "oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("public-domain", "domain", r"public domain"),
]

# priority, confidence and frame; NAME stands for a license's name
FRAMES = [
    (0, 1.0, r"spdx licen[cs]e identifier NAME(?: only| or later)?"),
    (1, 0.95, r"(?:is |are |be )?(?:licen[cs]ed|released|distributed|made available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:conditions of the )?NAME"),
    (1, 0.9, r"(?:subject to|in accordance with|governed by|under) the terms (?:and conditions )?of (?:the )?NAME"),
    (2, 0.7, r"NAME(?: only| or (?:any )?later(?: version)?)?"),
]

# priority, confidence, keyword, label, pattern
TEXTS = [
    (1, 0.95, "hereby", "mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (1, 0.9, "merchantability", "warranty-disclaimer", r"without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    (1, 0.9, "redistribution", "bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (1, 0.95, "neither", "bsd-3-clause", r"neither the name of (?:the )?(?:\S+ ){1,6}nor the names of its contributors may be used"),
    (1, 0.95, "advertising", "bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    (1, 0.95, "permission", "isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (1, 0.9, "altered", "zlib", r"altered source versions must be plainly marked as such"),
    (1, 0.9, "misrepresented", "zlib", r"the origin of this software must not be misrepresented"),
    (1, 0.95, "redistribute", "gpl", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    (1, 0.95, "redistribute", "lgpl", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    (1, 0.95, "redistribute", "agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    (1, 0.95, "compliance", "apache-2.0", r"you may not use this file except in compliance with the licen[cs]e"),
    (0, 1.0, "www", "apache-2.0", r"www apache org licenses license 2 0"),
    (0, 1.0, "opensource", "mit", r"opensource org licenses mit"),
    (0, 1.0, "opensource", "bsd-3-clause", r"opensource org licenses bsd 3 clause"),
    (0, 1.0, "gnu", "gpl-3.0", r"www gnu org licenses gpl 3 0"),
    (0, 1.0, "gnu", "gpl-2.0", r"www gnu org licenses (?:old licenses )?gpl 2 0"),
    (0, 1.0, "gnu", "lgpl", r"www gnu org licenses (?:old licenses )?lgpl"),
    (0, 1.0, "creativecommons", "cc-by-4.0", r"creativecommons org licenses by 4 0"),
    (0, 1.0, "creativecommons", "cc-by-3.0", r"creativecommons org licenses by 3 0"),
    (0, 1.0, "creativecommons", "cc-by-sa-4.0", r"creativecommons org licenses by sa 4 0"),
    (0, 1.0, "creativecommons", "cc-by-nc-4.0", r"creativecommons org licenses by nc 4 0"),
    (0, 1.0, "creativecommons", "cc-by-nc-sa-4.0", r"creativecommons org licenses by nc sa 4 0"),
    (0, 1.0, "creativecommons", "cc-by-nc-nd-4.0", r"creativecommons org licenses by nc nd 4 0"),
    (0, 1.0, "creativecommons", "cc0-1.0", r"creativecommons org publicdomain zero 1 0"),
    (0, 1.0, "mozilla", "mpl-2.0", r"mozilla org mpl 2 0"),
    (1, 0.95, "subject", "mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    (1, 0.9, "unencumbered", "unlicense", r"this is free and unencumbered software released into the public domain"),
    (1, 0.9, "waived", "cc0-1.0", r"has waived all copyright and related or neighboring rights"),
    (1, 0.9, "dedicated", "public-domain", r"(?:is |are )?dedicated to the public domain"),
    (1, 0.8, "reserved", "all-rights-reserved", r"all rights reserved"),
    (2, 0.6, "proprietary", "proprietary", r"proprietary and confidential"),
    (2, 0.6, "confidential", "proprietary", r"unauthorized copying of this file via any medium is strictly prohibited"),
    (2, 0.6, "noncommercial", "non-commercial", r"(?:for )?noncommercial use only"),
    (2, 0.6, "commercial", "non-commercial", r"(?:for )?non commercial use only"),
    (2, 0.5, "dual", "dual-licensed", r"dual licen[cs]ed"),
    (3, 0.3, "licensed", "unknown-license", r"licen[cs]ed under(?: the)?(?: \S+){1,3}"),
    (3, 0.3, "copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
]


def rules() -> list[Rule]:
    """All rules: the base phrases first, then every name in every frame,
    then the further signatures."""
    out = [(2, key, phrase, label, 0.6, True) for phrase, label, key in BASE]
    out += [(priority, key, frame.replace("NAME", f"(?:{name})"), label, confidence, False)
            for priority, confidence, frame in FRAMES for label, key, name in NAMES]
    out += [(priority, key, pattern, label, confidence, False) for priority, confidence, key, label, pattern in TEXTS]
    return [Rule(i, *r) for i, r in enumerate(out)]
