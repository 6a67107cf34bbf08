"""License scans with ordered signature rules, in DataFrame functions only.

A text is brought to one form: runs of separators become one space, A-Z are lower-cased, and a space stands at either end, so
rules are written over words. Every rule has a keyword, which every string of its pattern contains; it runs only on texts
with its keyword, and keywords are looked for only in texts that have the one of a few words that covers them. Matches are ordered by
start, longest first. A match inside another of at least its priority is suppressed, but for base rules, which always stay.

All steps are expressions over one row, so the plan is a scan and a projection, without shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The contract's phrases: label, words.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

#: Hand-written signatures, most specific first within a priority: label, keyword, pattern over words. Priorities: 0 tags and
#: full notices, 1 names with a version or clause, 2 bare names and links, 3 generic phrases.
VERSION = r"(?: version| v| ver)?"
SIGNATURES: list[tuple[int, str, str, str]] = [
    # Notices
    (0, "mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (0, "mit", "the software is provided as is", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    (0, "isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    (0, "0bsd", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    (0, "bsd-3-clause", "neither the name", r"neither the names? of (?:the )?(?:\w+ ){1,8}(?:n?or the names of its|nor the names of) contributors may be used to endorse or promote products"),
    (0, "bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (0, "bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (0, "apache-2.0", "licensed under the apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (0, "gpl-3.0-or-later", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (0, "gpl-2.0-or-later", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    (0, "gpl-3.0-only", "free software foundation", r"under the terms of the gnu general public license version 3 (?:only )?as published by the free software foundation"),
    (0, "gpl-2.0-only", "free software foundation", r"under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    (0, "lgpl-2.1-or-later", "free software foundation", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    (0, "lgpl-3.0-or-later", "free software foundation", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (0, "lgpl-2.0-or-later", "free software foundation", r"under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    (0, "agpl-3.0-or-later", "free software foundation", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (0, "gfdl-1.3", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    (0, "gfdl-1.2", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2"),
    (0, "mpl-2.0", "mozilla public", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    (0, "mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public license version 1 1"),
    (0, "epl-2.0", "eclipse public", r"made available under the terms of the eclipse public license 2 0"),
    (0, "epl-1.0", "eclipse public", r"made available under the terms of the eclipse public license v?1 0"),
    (0, "cddl-1.0", "common development and distribution", r"subject to the terms of the common development and distribution license(?: the license)?"),
    (0, "unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    (0, "wtfpl", "fuck you want", r"do what the fuck you want to public license"),
    (0, "zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (0, "bsl-1.0", "boost software", r"distributed under the boost software license version 1 0"),
    (0, "cc0-1.0", "waived all copyright", r"(?:has|have) waived all copyright and related or neighboring rights"),
    (0, "public-domain", "dedicated to the public domain", r"(?:is|are|hereby) dedicated to the public domain"),
    (0, "openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    (0, "python-2.0", "python software foundation", r"python software foundation license version 2"),
    (0, "ofl-1.1", "sil open font", r"this font software is licensed under the sil open font license version 1 1"),
    (0, "x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    (0, "ncsa", "developed by", r"developed by (?:\w+ ){1,12}permission is hereby granted free of charge"),
    (0, "postgresql", "postgresql", r"postgresql is released under the postgresql license"),
    (0, "json", "used for good", r"the software shall be used for good not evil"),
    (0, "beerware", "buy me a beer", r"you can buy me a beer in return"),
    (0, "ms-pl", "accompanying software", r"this license governs use of the accompanying software"),
    (0, "artistic-2.0", "artistic license", r"artistic license 2 0 copyright"),
    (0, "vim", "charityware", r"vim is charityware"),
    # Names with versions
    (1, "gpl-3.0", "gpl", r"(?:gnu )?gpl{v} ?3(?: 0)?(?! \d)"), (1, "gpl-2.0", "gpl", r"(?:gnu )?gpl{v} ?2(?: 0)?(?! \d)"), (1, "gpl-1.0", "gpl", r"(?:gnu )?gpl{v} ?1(?: 0)?(?! \d)"),
    (1, "gpl-3.0", "general public license", r"gnu general public license{v} 3(?: 0)?"), (1, "gpl-2.0", "general public license", r"gnu general public license{v} 2(?: 0)?"),
    (1, "gpl-1.0", "general public license", r"gnu general public license{v} 1(?: 0)?"),
    (1, "gpl-3.0", "gplv3", r"gplv3(?: 0)?"), (1, "gpl-2.0", "gplv2", r"gplv2(?: 0)?"),
    (1, "lgpl-3.0", "lgpl", r"(?:gnu )?lgpl{v} ?3(?: 0)?"), (1, "lgpl-2.1", "lgpl", r"(?:gnu )?lgpl{v} ?2 1"), (1, "lgpl-2.0", "lgpl", r"(?:gnu )?lgpl{v} ?2 0"),
    (1, "lgpl-3.0", "lesser general public", r"gnu lesser general public license{v} 3(?: 0)?"), (1, "lgpl-2.1", "lesser general public", r"gnu lesser general public license{v} 2 1"),
    (1, "lgpl-2.0", "library general public", r"gnu library general public license{v} 2(?: 0)?"),
    (1, "agpl-3.0", "agpl", r"(?:gnu )?agpl{v} ?3(?: 0)?"), (1, "agpl-3.0", "affero", r"gnu affero general public license{v} 3(?: 0)?"), (1, "agpl-1.0", "affero", r"affero general public license{v} 1(?: 0)?"),
    (1, "gfdl-1.3", "free documentation", r"gnu free documentation license{v} 1 3"), (1, "gfdl-1.2", "free documentation", r"gnu free documentation license{v} 1 2"), (1, "gfdl-1.1", "free documentation", r"gnu free documentation license{v} 1 1"),
    (1, "apache-2.0", "apache", r"apache (?:software )?license{v} 2(?: 0)?"), (1, "apache-1.1", "apache", r"apache (?:software )?license{v} 1 1"), (1, "apache-1.0", "apache", r"apache (?:software )?license{v} 1 0"),
    (1, "apache-2.0", "apache", r"apache(?: v)? ?2(?: 0)?(?: license)?"),
    (1, "mpl-2.0", "mozilla", r"mozilla public license{v} 2(?: 0)?"), (1, "mpl-1.1", "mozilla", r"mozilla public license{v} 1 1"), (1, "mpl-1.0", "mozilla", r"mozilla public license{v} 1 0"),
    (1, "mpl-2.0", "mpl", r"mpl{v} ?2(?: 0)?"), (1, "mpl-1.1", "mpl", r"mpl{v} ?1 1"),
    (1, "epl-2.0", "eclipse", r"eclipse public license{v} 2(?: 0)?"), (1, "epl-1.0", "eclipse", r"eclipse public license{v} 1(?: 0)?"), (1, "edl-1.0", "eclipse", r"eclipse distribution license{v} 1 0"),
    (1, "cddl-1.0", "cddl", r"cddl{v} ?1 0"), (1, "cddl-1.1", "cddl", r"cddl{v} ?1 1"),
    (1, "eupl-1.2", "eupl", r"eupl{v} ?1 2"), (1, "eupl-1.1", "eupl", r"eupl{v} ?1 1"), (1, "eupl-1.2", "european union public", r"european union public licen[cs]e{v} 1 2"), (1, "eupl-1.1", "european union public", r"european union public licen[cs]e{v} 1 1"),
    (1, "osl-3.0", "open software license", r"open software license{v} 3(?: 0)?"), (1, "afl-3.0", "academic free", r"academic free license{v} 3(?: 0)?"), (1, "afl-2.1", "academic free", r"academic free license{v} 2 1"),
    (1, "artistic-2.0", "artistic", r"artistic license{v} 2(?: 0)?"), (1, "artistic-1.0", "artistic", r"artistic license{v} 1(?: 0)?"),
    (1, "bsl-1.0", "boost", r"boost software license{v} 1(?: 0)?"), (1, "bsl-1.1", "business source", r"business source license{v} 1 1"), (1, "sspl-1.0", "server side public", r"server side public license{v} 1"),
    (1, "bsd-3-clause", "bsd", r"bsd 3 clause(?: license)?"), (1, "bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: license)?"), (1, "bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd(?: license)?"),
    (1, "bsd-2-clause", "bsd", r"bsd 2 clause(?: license)?"), (1, "bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: license)?"), (1, "bsd-2-clause", "bsd", r"(?:simplified|freebsd) bsd(?: license)?"),
    (1, "bsd-4-clause", "bsd", r"bsd 4 clause(?: license)?"), (1, "bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: license)?"), (1, "bsd-4-clause", "bsd", r"(?:original|old) bsd(?: license)?"), (1, "0bsd", "bsd", r"(?:zero|0) clause bsd(?: license)?"),
    (1, "bsd-3-clause-clear", "bsd", r"clear bsd(?: license)?"), (1, "bsd-2-clause-patent", "bsd", r"bsd 2 clause (?:plus )?patent(?: license)?"),
    (1, "cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"), (1, "cc0-1.0", "creative commons", r"creative commons (?:zero|cc0|public domain dedication)(?: v?1 0)?"),
    (1, "cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"), (1, "cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"), (1, "cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"), (1, "cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    (1, "cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"), (1, "cc-by-4.0", "cc", r"cc by 4 0"), (1, "cc-by-3.0", "cc", r"cc by 3 0"), (1, "cc-by-2.5", "cc", r"cc by 2 5"), (1, "cc-by-2.0", "cc", r"cc by 2 0"), (1, "cc-by-1.0", "cc", r"cc by 1 0"),
    (1, "cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: (?:works )?[1-4] [05])?"), (1, "cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    (1, "cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"), (1, "cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?"),
    (1, "cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"), (1, "cc-by-4.0", "creative commons", r"creative commons attribution 4 0"), (1, "cc-by-3.0", "creative commons", r"creative commons attribution 3 0"),
    (1, "cc-by-2.0", "creative commons", r"creative commons attribution 2 [05]"),
    (1, "odbl-1.0", "odbl", r"odbl{v}(?: 1 0)?"), (1, "odbl-1.0", "open database", r"open database license{v}(?: 1 0)?"), (1, "odc-by-1.0", "open data commons", r"open data commons attribution license"), (1, "pddl-1.0", "public domain dedication", r"public domain dedication and license"),
    (1, "cdla-permissive-2.0", "cdla", r"cdla permissive 2 0"), (1, "cdla-permissive-1.0", "cdla", r"cdla permissive 1 0"), (1, "cdla-sharing-1.0", "cdla", r"cdla sharing 1 0"), (1, "cdla-permissive-1.0", "community data license", r"community data license agreement permissive"), (1, "cdla-sharing-1.0", "community data license", r"community data license agreement sharing"),
    (1, "openrail-m", "openrail", r"(?:creativeml )?openrail{v}(?: m)?"), (1, "llama-2", "llama", r"llama 2 community license"), (1, "llama-3", "llama", r"llama 3(?: \d)? community license"),
    (1, "ofl-1.1", "ofl", r"ofl{v} ?1 1"), (1, "ofl-1.1", "open font", r"(?:sil )?open font license{v}(?: 1 1)?"), (1, "lppl-1.3c", "latex project", r"latex project public license{v}(?: 1 3c?)?"), (1, "zpl-2.1", "zope", r"zope public license{v} 2 1"), (1, "php-3.01", "php license", r"php license{v} 3 01"),
    (1, "cecill-2.1", "cecill", r"cecill{v} 2 1"), (1, "cecill-b", "cecill", r"cecill b"), (1, "cecill-c", "cecill", r"cecill c"), (1, "ms-pl", "ms pl", r"ms pl"), (1, "ms-rl", "ms rl", r"ms rl"), (1, "upl-1.0", "universal permissive", r"universal permissive license{v}(?: 1 0)?"),
    (1, "elastic-2.0", "elastic license", r"elastic license{v} 2(?: 0)?"), (1, "polyform-nc-1.0", "polyform", r"polyform noncommercial(?: license)?(?: 1 0 0)?"), (1, "polyform-sb-1.0", "polyform", r"polyform small business(?: license)?(?: 1 0 0)?"), (1, "mulan-psl-2.0", "mulan", r"mulan(?: permissive software license| psl){v} 2"),
    # Links
    (2, "mit", "opensource", r"opensource org licenses? mit"), (2, "bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"), (2, "bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"), (2, "isc", "opensource", r"opensource org licenses? isc"),
    (2, "apache-2.0", "apache", r"apache org licenses license 2 0"), (2, "apache-2.0", "opensource", r"opensource org licenses? apache 2 0"), (2, "gpl-3.0", "gnu", r"gnu org licenses gpl 3 0"), (2, "gpl-2.0", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0"), (2, "lgpl-3.0", "gnu", r"gnu org licenses lgpl 3 0"),
    (2, "lgpl-2.1", "gnu", r"gnu org licenses (?:old licenses )?lgpl 2 1"), (2, "agpl-3.0", "gnu", r"gnu org licenses agpl 3 0"), (2, "gfdl-1.3", "gnu", r"gnu org licenses fdl(?: 1 3)?"), (2, "gpl", "gnu", r"gnu org (?:licenses|copyleft) gpl"), (2, "lgpl", "gnu", r"gnu org (?:licenses|copyleft) lgpl"),
    (2, "mpl-2.0", "mozilla", r"mozilla org mpl 2 0"), (2, "mpl-1.1", "mozilla", r"mozilla org mpl (?:mpl )?1 1"), (2, "epl-1.0", "eclipse", r"eclipse org legal epl v10"), (2, "epl-2.0", "eclipse", r"eclipse org legal epl (?:v20|2 0)"), (2, "bsl-1.0", "boost", r"boost org license 1 0"), (2, "unlicense", "unlicense", r"unlicense org"),
    (2, "wtfpl", "wtfpl", r"wtfpl(?: net)?"), (2, "ofl-1.1", "scripts sil", r"scripts sil org ofl"), (2, "cc-by-4.0", "creativecommons", r"creativecommons org licenses by 4 0"), (2, "cc-by-3.0", "creativecommons", r"creativecommons org licenses by 3 0"), (2, "cc-by-2.0", "creativecommons", r"creativecommons org licenses by 2 [05]"),
    (2, "cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] [05])?"), (2, "cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] [05])?"), (2, "cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] [05])?"), (2, "cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    (2, "cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"), (2, "cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"), (2, "public-domain", "creativecommons", r"creativecommons org publicdomain mark(?: 1 0)?"), (2, "odbl-1.0", "opendatacommons", r"opendatacommons org licenses odbl"),
    (2, "odc-by-1.0", "opendatacommons", r"opendatacommons org licenses by"), (2, "pddl-1.0", "opendatacommons", r"opendatacommons org licenses pddl"),
    # Bare names
    (2, "gpl", "gpl", r"gpl"), (2, "gpl", "gpled", r"gpled"), (2, "gpl", "gnu public", r"gnu public license"), (2, "lgpl", "lgpl", r"lgpl"), (2, "lgpl", "lesser general public", r"gnu lesser general public license"), (2, "lgpl", "library general public", r"gnu library general public license"), (2, "agpl", "agpl", r"agpl"),
    (2, "agpl", "affero", r"(?:gnu )?affero general public license"), (2, "gfdl", "free documentation", r"gnu free documentation license"), (2, "gfdl", "gfdl", r"gfdl"), (2, "apache", "apache", r"apache software license"), (2, "mit", "mit", r"(?:under|the) mit licen[cs]ed?"), (2, "mit", "mit", r"mit licensed"), (2, "mit", "expat", r"expat license"), (2, "x11", "x11", r"x11 license"),
    (2, "isc", "isc", r"isc license"), (2, "bsd", "bsd", r"bsd (?:style )?licen[cs]ed?"), (2, "zlib", "zlib", r"zlib(?: libpng)? license"), (2, "libpng", "libpng", r"libpng license"), (2, "mpl", "mozilla", r"mozilla public license"), (2, "epl", "eclipse", r"eclipse public license"), (2, "cddl", "cddl", r"cddl"), (2, "cddl", "common development and distribution", r"common development and distribution license"),
    (2, "eupl", "european union public", r"european union public licen[cs]e"), (2, "osl", "open software license", r"open software license"), (2, "afl", "academic free", r"academic free license"), (2, "artistic", "artistic", r"artistic license"), (2, "bsl-1.0", "boost", r"boost (?:software )?license"), (2, "busl", "business source", r"business source license"), (2, "sspl", "sspl", r"sspl"), (2, "sspl", "server side public", r"server side public license"),
    (2, "creative-commons", "creative commons", r"creative commons(?: licen[cs]e)?"), (2, "cc-by", "creative commons", r"creative commons attribution(?: licen[cs]e)?"), (2, "unlicense", "unlicense", r"(?:the )?unlicense"), (2, "ofl", "open font", r"open font license"), (2, "openrail", "responsible ai", r"responsible ai license"), (2, "openrail", "rail", r"rail license"), (2, "llama", "llama", r"llama community license"), (2, "python-2.0", "psf", r"psf license"), (2, "ruby", "ruby", r"ruby license"), (2, "php", "php license", r"php license"),
    (2, "perl", "perl", r"same terms as perl(?: itself)?"), (2, "postgresql", "postgresql", r"postgresql license"), (2, "openssl", "openssl", r"openssl license"), (2, "curl", "curl", r"curl license"), (2, "ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? license"), (2, "hpnd", "historical permission", r"historical permission notice and disclaimer"), (2, "w3c", "w3c", r"w3c(?: software)?(?: notice and)? license"), (2, "unicode", "unicode", r"unicode license"),
    (2, "sleepycat", "sleepycat", r"sleepycat license"), (2, "qpl", "q public", r"q public license"), (2, "ipl", "ibm public", r"ibm public license"), (2, "cpl", "common public", r"common public license"), (2, "cpal", "common public attribution", r"common public attribution license"), (2, "rpl", "reciprocal public", r"reciprocal public license"), (2, "nasa", "nasa", r"nasa open source agreement"), (2, "ecl-2.0", "educational community", r"educational community license"),
    (2, "ogl-uk-3.0", "open government", r"open government licen[cs]e"), (2, "beerware", "ware license", r"beer ?ware license"), (2, "jsr", "java research", r"java research license"), (2, "sun-bcl", "binary code license", r"binary code license(?: agreement)?"), (2, "vim", "vim license", r"vim license"), (2, "tcl", "tcl", r"tcl tk license"), (2, "naist", "naist", r"naist license"), (2, "freetype", "freetype", r"freetype (?:project )?license"), (2, "ijg", "independent jpeg", r"independent jpeg group"),
    # Generic
    (3, "proprietary", "proprietary", r"proprietary (?:and confidential|license|software)"), (3, "all-rights-reserved", "all rights reserved", r"all rights reserved"), (3, "commercial", "commercial license", r"commercial license"), (3, "eula", "end user license", r"end user license agreement"), (3, "public-domain", "public domain", r"(?:in|into) the public domain"),
    (3, "no-license", "unlicensed", r"unlicensed"), (3, "freeware", "freeware", r"freeware"), (3, "shareware", "shareware", r"shareware"), (3, "see-license", "see licen", r"see licen[cs]e(?: file| txt| md)?"), (3, "see-license", "see the licen", r"see the licen[cs]e(?: file| txt| md)?"), (3, "open-source", "open source license", r"open source license"),
]

#: Identifiers that a tag may name, with their versions' words.
TAGGED = "mit|isc|0bsd|bsd 2 clause|bsd 3 clause|bsd 4 clause|apache 2 0|gpl 2 0 only|gpl 2 0 or later|gpl 3 0 only|gpl 3 0 or later|gpl 2 0|gpl 3 0|lgpl 2 1 only|lgpl 2 1 or later|lgpl 3 0 only|lgpl 3 0 or later|lgpl 2 1|lgpl 3 0|agpl 3 0 only|agpl 3 0 or later|agpl 3 0|mpl 2 0|mpl 1 1|epl 1 0|epl 2 0|cddl 1 0|unlicense|wtfpl|zlib|bsl 1 0|cc0 1 0|cc by 4 0|cc by 3 0|cc by sa 4 0|cc by sa 3 0|cc by nc 4 0|cc by nd 4 0|cc by nc sa 4 0|cc by nc nd 4 0|ofl 1 1|artistic 2 0|eupl 1 2|ms pl|postgresql|python 2 0|ncsa|openssl|gfdl 1 3 only|gfdl 1 3 or later|odbl 1 0|upl 1 0|afl 3 0|osl 3 0|ecl 2 0|lppl 1 3c|hpnd|x11|vim|ruby|curl"
WEIGHTS = (1.0, 0.9, 0.7, 0.3)


def _identifier(words: str) -> str:
    out: list[str] = []
    for w in words.split(" "):
        if w.isdigit() and len(w) == 1 and len(out) > 1 and out[-1] in "0123456789" and out[-2] != "clause":
            out[-1] += "." + w
        else:
            out.append(w)
    return "-".join(out)


def rules() -> list[tuple[str, int, bool, str, str]]:
    """(label, priority, base, keyword, pattern): all rules in order."""
    out = [(label, 2, True, words, words) for label, words in BASE]
    out += [(_identifier(x), 0, False, "spdx license identifier", f"spdx license identifier (?:\\w+ or )?{x}") for x in TAGGED.split("|")]
    out += [(label, p, False, keyword, pattern.replace("{v}", VERSION)) for p, label, keyword, pattern in SIGNATURES]
    return out


def gate_words(keywords: list[str]) -> list[str]:
    """Few words of which every keyword has one: again and again, the word that most of the remaining keywords have."""
    left, out = sorted(set(keywords)), []
    while left:
        words = sorted({w for k in left for w in k.split()}, key=lambda w: (-sum(w in k.split() for k in left), -len(w), w))
        out.append(words[0])
        left = [k for k in left if words[0] not in k.split()]
    return out


#: Matches of a text are taken in runs of so many: within a run lists are appended to, across runs only sums are carried.
RUN = 32


def _once(value: Column, f) -> Column:
    """f(value) with the value made once: as a lambda's argument it isn't computed again for every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(n: Column) -> Column:
    """0 to the number of the last run of n entries; none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))


def _run(values: Column, k: Column) -> Column:
    return F.slice(values, k * RUN + 1, F.lit(RUN))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _found(text: Column, pattern: Column) -> Column:
    """(a, b, first, end) of every match in order, in characters and in words: what stands between the matches gives their places.

    Linear in the text but for appending a sum for each run of matches.
    """
    sizes = lambda x: F.struct(F.length(x).alias("c"), _spaces(x).alias("w"))
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), sizes)
    parts = F.struct(hits.alias("hits"), F.transform(F.split(text, pattern, -1), sizes).alias("gaps"))

    def step(s: Column, x: Column) -> Column:
        c, w = s["c"] + x["gaps"]["c"], s["w"] + x["gaps"]["w"]
        one = F.struct(c.alias("a"), (c + x["hits"]["c"]).alias("b"), w.alias("first"), (w + x["hits"]["w"]).alias("end"))
        return F.struct((c + x["hits"]["c"]).alias("c"), (w + x["hits"]["w"]).alias("w"), F.concat(s["out"], F.array(one)).alias("out"))

    def both(p: Column) -> Column:
        return F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["hits"])), p["hits"], lambda g, h: F.struct(g.alias("gaps"), h.alias("hits")))

    def places(pairs: Column) -> Column:
        kind = "array<struct<a:int,b:int,first:int,end:int>>"
        runs = _runs(F.size(pairs))
        # What stands before each run.
        zero = F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("w")))
        total = lambda x, f: F.aggregate(x, F.lit(0), lambda s, y: s + y["gaps"][f] + y["hits"][f])
        before = F.aggregate(runs, zero, lambda s, k: F.concat(s, F.array(F.struct((F.element_at(s, F.lit(-1))["c"] + total(_run(pairs, k), "c")).alias("c"), (F.element_at(s, F.lit(-1))["w"] + total(_run(pairs, k), "w")).alias("w")))))

        def placed(b: Column) -> Column:
            own = lambda k: F.aggregate(_run(pairs, k), F.struct(F.get(b, k)["c"].alias("c"), F.get(b, k)["w"].alias("w"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])
            return F.flatten(F.transform(runs, own))

        return _once(before, placed)

    return _once(parts, lambda p: _once(both(p), places))


def _kept(matches: Column, base: Column) -> Column:
    """The matches, ordered by start and longest first, without those inside another of at least their priority; base rules stay.

    A match that ends no later than an earlier one of at least its priority is inside it, so the largest ends so far, by priority, decide.
    """
    kinds = len(WEIGHTS)
    every = F.array(*[F.lit(p) for p in range(kinds)])

    def step(s: Column, m: Column) -> Column:
        inside = F.array_max(F.slice(s["ends"], F.lit(1), m["p"] + 1)) >= -m["z"]
        stays = ~inside | F.get(base, m["i"])
        ends = F.transform(s["ends"], lambda e, k: F.when(k == m["p"], F.greatest(e, -m["z"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(stays, F.concat(s["out"], F.array(m))).otherwise(s["out"]).alias("out"))

    def staying(all_: Column) -> Column:
        runs = _runs(F.size(all_))
        furthest = lambda k: F.transform(every, lambda p: F.coalesce(F.array_max(F.transform(F.filter(_run(all_, k), lambda m: m["p"] == p), lambda m: -m["z"])), F.lit(-1)))
        zero = F.array(F.array(*[F.lit(-1)] * kinds))
        before = F.aggregate(runs, zero, lambda s, k: F.concat(s, F.array(F.zip_with(F.element_at(s, F.lit(-1)), furthest(k), lambda x, y: F.greatest(x, y)))))
        own = lambda b, k: F.aggregate(_run(all_, k), F.struct(F.get(b, k).alias("ends"), F.array().cast(MATCH).alias("out")), step, lambda s: s["out"])
        return _once(before, lambda b: F.flatten(F.transform(runs, lambda k: own(b, k))))

    return _once(matches, staying)


MATCH = "array<struct<a:int,z:int,p:int,i:int,first:int,end:int>>"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Words are runs of digits, letters and all characters from U+0080 on, A-Z lower-cased. n_base counts the places of the BASE phrases; first_word
    and last_word are their smallest and largest start in words (null without any). labels are those of the matches
    that stay, base_labels those of base rules alone, both distinct, sorted, comma-joined. score is the largest weight of a match that stays,
    by its priority (0 without any). detections: (label, priority, base, first and last word + 1) of each match that stays, by place.
    Matches of one place and length are ordered by priority, then by the order of the rules; the first suppresses the others of its priority or a lesser one.
    Null texts are empty; repeated rows get a row each; an empty table gives none; columns with the result's names are replaced. A text is scanned whole, in
    time linear in its length but for about a thousandth of the square of its number of matches.
    """
    every = rules()
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    form_, kept_ = fresh(docs, "__form", "__kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    form = F.concat(F.lit(" "), F.translate(F.trim(F.regexp_replace(text, SEPARATOR, " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" "))
    out = docs.drop(*results).withColumn(form_, form)
    gates = gate_words([r[3] for r in every])
    by_keyword: dict[str, list[int]] = {}
    for i, (_, _, _, keyword, _) in enumerate(every):
        by_keyword.setdefault(keyword, []).append(i)
    words = F.col(form_)

    def literal(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    label, priority = literal([r[0] for r in every]), F.array(*[F.lit(r[1]) for r in every])
    pattern, base = literal([f" (?:{r[4]})(?= )" for r in every]), F.array(*[F.lit(r[2]) for r in every])
    # Keywords are looked for by their gate word, so that most of a text's tests are of gate words alone.
    by_word: dict[str, list[str]] = {}
    for keyword in by_keyword:
        by_word.setdefault(next(w for w in gates if w in keyword.split()), []).append(keyword)
    one = lambda k: F.struct(F.lit(k).alias("k"), F.array(*[F.lit(i) for i in by_keyword[k]]).alias("rules"))
    groups = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*[one(k) for k in some]).alias("keywords")) for w, some in by_word.items()])
    there = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(words, g["w"])), lambda g: g["keywords"]))
    open_rules = F.flatten(F.transform(F.filter(there, lambda g: F.contains(words, g["k"])), lambda g: g["rules"]))
    match = lambda m, i: F.struct(m["a"].alias("a"), (-m["b"]).alias("z"), F.get(priority, i).alias("p"), i.alias("i"), m["first"].alias("first"), m["end"].alias("end"))
    matches = F.array_sort(F.flatten(F.transform(open_rules, lambda i: F.transform(_found(words, F.get(pattern, i)), lambda m: match(m, i)))))
    out = out.withColumn(kept_, _kept(matches, base))
    kept = F.col(kept_)
    ours = F.filter(kept, lambda m: F.get(base, m["i"]))  # base rules

    def joined(some: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda m: F.get(label, m["i"])))), ",")

    detections = F.transform(kept, lambda m: F.struct(F.get(label, m["i"]).alias("label"), m["p"].alias("priority"), F.get(base, m["i"]).alias("base"), m["first"].cast("long").alias("first"), m["end"].cast("long").alias("end")))
    weight = F.array(*[F.lit(w) for w in WEIGHTS])
    starts = F.transform(ours, lambda m: m["first"].cast("long"))
    out = out.withColumns({
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "n_base": F.size(ours).cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": joined(ours),
        "labels": joined(kept),
        "score": F.coalesce(F.array_max(F.transform(kept, lambda m: F.get(weight, m["p"]))), F.lit(0.0)),
        "detections": detections,
    })
    return out.drop(form_, kept_)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """What the scan finds in every document; null and wordless texts have no words, places or labels and score 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
