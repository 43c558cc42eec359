"""Signature rules of the licence scan, in order.

A rule is (name, label, priority, keyword, regex).  Regexes run on normalised
text: lower-cased words, one space before each and one at the end, so ``\\b``
is never needed and punctuation and line breaks cannot split a phrase.  The
keyword is a plain byte string that every match contains; it gates the regex.
Some are signatures written by hand from the wording of the licences; the others
are hand-written sentence forms spelled out for each licence from its names and
short tags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int  # larger wins over what it contains or equals
    keyword: bytes
    regex: re.Pattern[bytes]
    weight: float  # how sure a match makes the label


#: The phrases whose places are always reported.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label: (spoken names, short tags as they read once punctuation is a space)
_LICENSES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "mit": (("mit license", "mit expat license", "expat license"), ("mit", "mit 0")),
    "apache": (("apache license", "apache software license"), ("apache 2 0", "apache 1 1")),
    "gpl": (("gnu general public license", "general public license", "gnu gpl"), ("gpl 2 0", "gpl 3 0", "gpl 2 0 only", "gpl 3 0 or later")),
    "lgpl": (("gnu lesser general public license", "lesser general public license", "gnu library general public license"), ("lgpl 2 1", "lgpl 3 0")),
    "agpl": (("gnu affero general public license", "affero general public license"), ("agpl 3 0",)),
    "bsd": (("bsd license", "new bsd license", "simplified bsd license", "modified bsd license", "revised bsd license"), ("bsd 2 clause", "bsd 3 clause", "bsd 4 clause")),
    "mpl": (("mozilla public license",), ("mpl 1 1", "mpl 2 0")),
    "epl": (("eclipse public license",), ("epl 1 0", "epl 2 0")),
    "cddl": (("common development and distribution license",), ("cddl 1 0", "cddl 1 1")),
    "cc-by": (("creative commons attribution license", "creative commons attribution 4 0 international license"), ("cc by 3 0", "cc by 4 0")),
    "cc-by-sa": (("creative commons attribution sharealike license", "creative commons attribution share alike license"), ("cc by sa 3 0", "cc by sa 4 0")),
    "cc-by-nc": (("creative commons attribution noncommercial license", "creative commons attribution non commercial license"), ("cc by nc 3 0", "cc by nc 4 0")),
    "cc-by-nd": (("creative commons attribution noderivatives license",), ("cc by nd 3 0", "cc by nd 4 0")),
    "cc0": (("creative commons zero license", "cc0 public domain dedication"), ("cc0 1 0",)),
    "isc": (("isc license", "internet systems consortium license"), ("isc",)),
    "zlib": (("zlib license", "zlib libpng license"), ("zlib",)),
    "boost": (("boost software license",), ("bsl 1 0",)),
    "artistic": (("artistic license", "perl artistic license"), ("artistic 1 0", "artistic 2 0")),
    "unlicense": (("the unlicense",), ("unlicense",)),
    "wtfpl": (("do what the fuck you want to public license",), ("wtfpl",)),
    "eupl": (("european union public license", "european union public licence"), ("eupl 1 1", "eupl 1 2")),
    "ofl": (("sil open font license", "open font license"), ("ofl 1 1",)),
    "gfdl": (("gnu free documentation license",), ("gfdl 1 2", "gfdl 1 3")),
    "psf": (("python software foundation license", "psf license"), ("psf 2 0", "python 2 0")),
    "php": (("php license",), ("php 3 0", "php 3 01")),
    "ruby": (("ruby license",), ("ruby",)),
    "ms-pl": (("microsoft public license",), ("ms pl",)),
    "ms-rl": (("microsoft reciprocal license",), ("ms rl",)),
    "osl": (("open software license",), ("osl 3 0",)),
    "afl": (("academic free license",), ("afl 3 0",)),
    "ecl": (("educational community license",), ("ecl 2 0",)),
    "ncsa": (("university of illinois ncsa open source license",), ("ncsa",)),
    "odbl": (("open database license",), ("odbl 1 0",)),
    "upl": (("universal permissive license",), ("upl 1 0",)),
}

#: (form, priority, keyword, weight); N stands for a licence's name, T for a tag.
_FORMS: tuple[tuple[str, str, int, str, float], ...] = (
    ("licensed", " (?:dual |re |sub )?licensed under (?:the )?(?:terms of )?(?:the )?N(?: version [0-9]+(?: [0-9]+)?| v[0-9]+(?: [0-9]+)?)?", 50, "licensed under", 0.95),
    ("released", " (?:released|distributed|published|available|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?N", 48, " under ", 0.9),
    ("terms", " (?:subject to|according to|governed by) the (?:terms|conditions) of (?:the )?N", 46, " of ", 0.9),
    ("copy", " (?:see|read|copy of|text of|included) (?:the )?N", 30, "", 0.6),
    ("version", " N (?:version |v)[0-9]+(?: [0-9]+)?", 40, "", 0.8),
    ("name", " N", 20, "", 0.6),
    ("spdx", " spdx license identifier T", 60, "spdx", 0.99),
    ("field", " license(?:s)? T", 25, "license", 0.7),
)

#: name, label, priority, keyword, regex, weight
_SINGLE: tuple[tuple[str, str, int, str, str, float], ...] = (
    ("mit-grant", "mit", 70, "permission is hereby granted", r" permission is hereby granted free of charge to any person obtaining a copy", 0.97),
    ("mit-notice", "mit", 65, "copyright notice", r" the above copyright notice and this permission notice shall be included in all copies", 0.95),
    ("warranty-mit", "mit", 55, "as is", r" the software is provided as is without warranty of any kind express or implied", 0.8),
    ("isc-grant", "isc", 70, "permission to use", r" permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd-redistribution", "bsd", 70, "redistribution and use", r" redistribution and use in source and binary forms with or without modification", 0.95),
    ("bsd-endorse", "bsd", 60, "endorse or promote", r" may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-advertising", "bsd", 60, "advertising materials", r" all advertising materials mentioning features or use of this software", 0.9),
    ("apache-obtain", "apache", 70, "you may obtain a copy", r" you may obtain a copy of the license at http www apache org licenses", 0.97),
    ("apache-comply", "apache", 60, "compliance with the license", r" you may not use this file except in compliance with the license", 0.85),
    ("apache-url", "apache", 58, "apache org", r" www apache org licenses license 2 0", 0.95),
    ("gpl-free", "gpl", 70, "free software", r" this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.97),
    ("gpl-version", "gpl", 62, "free software foundation", r" as published by the free software foundation either version [0-9]+ of the license", 0.85),
    ("gpl-hope", "gpl", 55, "hope that it will be useful", r" distributed in the hope that it will be useful but without any warranty", 0.75),
    ("gpl-url", "gpl", 58, "gnu org", r" www gnu org (?:licenses|copyleft) gpl", 0.9),
    ("lgpl-free", "lgpl", 72, "free software", r" this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.97),
    ("lgpl-url", "lgpl", 59, "gnu org", r" www gnu org (?:licenses|copyleft) lgpl", 0.9),
    ("agpl-url", "agpl", 59, "gnu org", r" www gnu org licenses agpl", 0.9),
    ("mpl-form", "mpl", 70, "mozilla", r" this source code form is subject to the terms of the mozilla public license", 0.97),
    ("mpl-url", "mpl", 58, "mozilla org", r" (?:www )?mozilla org mpl", 0.9),
    ("epl-url", "epl", 58, "eclipse org", r" www eclipse org legal epl", 0.9),
    ("boost-url", "boost", 58, "boost org", r" www boost org license 1 0 txt", 0.95),
    ("cc-url-by-sa", "cc-by-sa", 60, "creativecommons", r" creativecommons org licenses by sa [0-9]+ [0-9]+", 0.97),
    ("cc-url-by-nc", "cc-by-nc", 60, "creativecommons", r" creativecommons org licenses by nc [0-9]+ [0-9]+", 0.97),
    ("cc-url-by-nd", "cc-by-nd", 60, "creativecommons", r" creativecommons org licenses by nd [0-9]+ [0-9]+", 0.97),
    ("cc-url-by", "cc-by", 56, "creativecommons", r" creativecommons org licenses by [0-9]+ [0-9]+", 0.97),
    ("cc-url-zero", "cc0", 60, "creativecommons", r" creativecommons org publicdomain zero 1 0", 0.97),
    ("zlib-alter", "zlib", 66, "altered source versions", r" altered source versions must be plainly marked as such", 0.9),
    ("unlicense-free", "unlicense", 66, "public domain", r" this is free and unencumbered software released into the public domain", 0.97),
    ("public-domain", "public-domain", 30, "public domain", r" (?:placed|released|dedicated|is) (?:in|into|to) the public domain", 0.7),
    ("wtfpl-line", "wtfpl", 66, "what the fuck", r" you just do what the fuck you want to", 0.97),
    ("ofl-line", "ofl", 66, "font software", r" this font software is licensed under the sil open font license", 0.97),
    ("beerware", "beerware", 66, "beer", r" buy me a beer in return", 0.9),
    ("all-rights", "proprietary", 15, "all rights reserved", r" all rights reserved", 0.5),
    ("copyright-line", "copyright", 10, "copyright", r" copyright (?:c )?(?:19|20)[0-9][0-9]", 0.4),
    ("confidential", "proprietary", 25, "confidential", r" (?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("no-reproduction", "proprietary", 28, "may be reproduced", r" no part of this (?:work|publication|document|book) may be reproduced", 0.8),
    ("permission-required", "proprietary", 26, "written permission", r" without (?:the )?(?:prior|express) written permission", 0.6),
    ("commercial", "proprietary", 26, "commercial license", r" (?:requires|under) a commercial license", 0.7),
    # sentences of the licences' own wording
    ("mit-deal", "mit", 66, "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons", r" without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons", 0.95),
    ("mit-subject", "mit", 64, "permission notice", r" subject to the following conditions the above copyright notice and this permission notice", 0.95),
    ("mit-liability", "mit", 54, "copyright holders be liable", r" in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.8),
    ("mit-dealings", "mit", 53, "other dealings in the software", r" (?:license )?(?:out of or in connection with the software or the use or )?other dealings in the software", 0.6),
    ("mit-0-grant", "mit", 71, "permission is hereby granted", r" permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 0.97),
    ("x11-notice", "x11", 64, "shall not be used in advertising", r" except as contained in this notice the names? of [a-z0-9 ]{1,80} shall not be used in advertising", 0.85),
    ("x11-authorization", "x11", 62, "written authorization", r" without prior written authorization from (?:the )?[a-z]+", 0.7),
    ("isc-notice", "isc", 64, "permission notice appear", r" provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("isc-disclaims", "isc", 60, "disclaims all warranties", r" the author disclaims all warranties with regard to this software", 0.85),
    ("isc-implied", "isc", 56, "implied warranties of merchantability", r" including all implied warranties of merchantability and fitness in no event shall the author be liable", 0.8),
    ("hpnd-grant", "hpnd", 63, "permission to use copy modify and distribute", r" permission to use copy modify and distribute this software and its documentation for any purpose", 0.9),
    ("hpnd-supporting", "hpnd", 62, "permission notice appear in supporting", r" both that copyright notice and this permission notice appear in supporting documentation", 0.9),
    ("hpnd-sell", "hpnd", 64, "permission to use copy modify distribute and sell", r" permission to use copy modify distribute and sell this software and its documentation", 0.92),
    ("bsd-retain", "bsd", 62, "redistributions of source code", r" redistributions of source code must retain the above copyright notice", 0.92),
    ("bsd-reproduce", "bsd", 62, "redistributions in binary form", r" redistributions in binary form must reproduce the above copyright notice", 0.92),
    ("bsd-permitted", "bsd", 60, "conditions are met", r" modification are permitted provided that the following conditions are met redistributions", 0.85),
    ("bsd-neither", "bsd", 60, "nor the names of its contributors may be used to endorse", r" neither the name of (?:the )?[a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse", 0.93),
    ("bsd-holders", "bsd", 55, "copyright holders and contributors", r" this software is provided by the copyright holders and contributors as is", 0.85),
    ("bsd-regents", "bsd", 58, "copyright", r" copyright (?:c )?[0-9 ]{0,20}the regents of the university of california", 0.8),
    ("bsd-consequential", "bsd", 52, "copyright", r" in no event shall the copyright (?:holder|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages", 0.75),
    ("bsd-acknowledge", "bsd", 59, "mentioning features or use of this software must display the following acknowledg", r" mentioning features or use of this software must display the following acknowledg(?:e)?ment", 0.9),
    ("bsd-patent", "bsd-patent", 64, "each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide", r" each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide", 0.92),
    ("bsd-clear", "bsd-clear", 64, "patent rights are granted by this license", r" no express or implied licenses to any party s patent rights are granted by this license", 0.95),
    ("bsd-zero", "0bsd", 72, "permission to use", r" permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", 0.96),
    ("apache-licensed", "apache", 68, "apache license version 2 0", r" licensed under the apache license version 2 0 the license", 0.97),
    ("apache-asis", "apache", 58, "distributed under the license is distributed", r" software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-governing", "apache", 57, "governing permissions", r" see the license for the specific language governing permissions and limitations under the license", 0.9),
    ("apache-terms", "apache", 66, "terms and conditions for use reproduction and distribution 1 definitions license shall mean", r" terms and conditions for use reproduction and distribution 1 definitions license shall mean", 0.97),
    ("apache-contribution", "apache", 64, "licensor for inclusion", r" intentionally submitted to (?:the )?licensor for inclusion in the work", 0.93),
    ("apache-patent", "apache", 63, "patent license", r" grant of patent license subject to the terms and conditions of this license each contributor hereby grants", 0.93),
    ("apache-derivative", "apache", 60, "you must cause any modified files to carry prominent notices stating that you changed the files", r" you must cause any modified files to carry prominent notices stating that you changed the files", 0.85),
    ("apache-notice", "apache", 60, "apache software foundation", r" this product includes software developed (?:by|at) the apache software foundation", 0.9),
    ("apache-cla", "apache", 55, "apache software foundation", r" licensed to the apache software foundation (?:asf )?under one or more contributor license agreements", 0.95),
    ("apache-11-name", "apache", 61, "apache software foundation must not be used", r" the names apache and apache software foundation must not be used to endorse", 0.95),
    ("gpl-received", "gpl", 60, "received a copy of the gnu general public license", r" you should have received a copy of the gnu general public license along with", 0.93),
    ("gpl-preamble", "gpl", 66, "freedom to share", r" the licenses for most software are designed to take away your freedom to share and change it", 0.95),
    ("gpl-freeprice", "gpl", 60, "free software we are referring", r" when we speak of free software we are referring to freedom not price", 0.85),
    ("gpl-verbatim", "gpl", 54, "verbatim copies of this license", r" everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.8),
    ("gpl-copyleft", "gpl", 62, "general public license is a free copyleft", r" the gnu general public license is a free copyleft license for software and other kinds of works", 0.96),
    ("gpl-version2", "gpl-2.0", 68, "general public license", r" under the terms of (?:the )?gnu general public license (?:as published by the free software foundation )?version 2(?: of the license)?(?: only)?", 0.93),
    ("gpl-version3", "gpl-3.0", 68, "general public license", r" under the terms of (?:the )?gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?", 0.93),
    ("gpl-later", "gpl", 61, "at your option any later version", r" (?:license )?or at your option any later version", 0.7),
    ("gpl-warranty-none", "gpl", 56, "absolutely no warranty", r" comes with absolutely no warranty for details type show w", 0.9),
    ("gpl-welcome", "gpl", 56, "free software and you are welcome", r" this is free software and you are welcome to redistribute it under certain conditions", 0.9),
    ("gpl-merchant", "gpl", 54, "implied warranty of merchantability", r" without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 0.9),
    ("gpl-accept", "gpl", 58, "accept this license", r" you are not required to accept this license (?:since you have not signed it|in order to receive or run a copy)", 0.88),
    ("gpl-tivo", "gpl-3.0", 60, "installation information", r" (?:corresponding source conveyed under this section|license) [a-z ]{0,80}must be accompanied by the installation information", 0.8),
    ("gpl-classpath", "gpl-classpath", 70, "special exception the copyright holders", r" as a special exception the copyright holders of this library give you permission to link this library with independent modules", 0.96),
    ("gpl-classpath-name", "gpl-classpath", 66, "gnu general public license", r" gnu general public license [a-z0-9 ]{0,40}with (?:the )?classpath exception", 0.92),
    ("gpl-font", "gpl-font", 66, "special exception if you create a document which uses this font and embed this font", r" special exception if you create a document which uses this font and embed this font", 0.93),
    ("gpl-linking", "gpl-linking", 64, "linking exception", r" (?:gnu )?(?:gpl|general public license) [a-z0-9 ]{0,30}with (?:a )?linking exception", 0.88),
    ("lgpl-received", "lgpl", 61, "received a copy of the gnu lesser general public license", r" you should have received a copy of the gnu lesser general public license along with", 0.94),
    ("lgpl-library", "lgpl", 61, "gnu library general public license", r" you should have received a copy of the gnu library general public license along with", 0.94),
    ("lgpl-preamble", "lgpl", 64, "lesser general public license", r" this license the lesser general public license applies to some specially designated software packages", 0.95),
    ("lgpl-combined", "lgpl", 60, "combined work", r" you may convey a combined work under terms of your choice", 0.85),
    ("lgpl-supplement", "lgpl", 63, "lesser general public license incorporates", r" this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 0.96),
    ("lgpl-21", "lgpl-2.1", 64, "lesser general public license", r" gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1", 0.92),
    ("lgpl-30", "lgpl-3.0", 64, "lesser general public license", r" gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3", 0.92),
    ("agpl-received", "agpl", 62, "received a copy of the gnu affero general public license", r" you should have received a copy of the gnu affero general public license along with", 0.95),
    ("agpl-network", "agpl", 62, "all users interacting with it remotely through a computer network", r" (?:license )?(?:your modified version must prominently offer )?all users interacting with it remotely through a computer network", 0.92),
    ("agpl-preamble", "agpl", 64, "affero general public license is a free copyleft", r" the gnu affero general public license is a free copyleft license for software and other kinds of works", 0.96),
    ("agpl-program", "agpl", 70, "affero general public license", r" it under the terms of the gnu affero general public license as published by", 0.95),
    ("gfdl-grant", "gfdl", 70, "permission is granted to copy distribute", r" permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.97),
    ("gfdl-invariant", "gfdl", 60, "with no invariant sections no front cover texts and no back cover texts a copy of the license", r" with no invariant sections no front cover texts and no back cover texts a copy of the license", 0.9),
    ("gfdl-purpose", "gfdl", 58, "this license is a kind of copyleft which means that derivative works of the document must themselves be free", r" this license is a kind of copyleft which means that derivative works of the document must themselves be free", 0.9),
    ("mpl-obtain", "mpl", 62, "mozilla org mpl", r" if a copy of the mpl was not distributed with this file you can obtain one at (?:http|https) (?:www )?mozilla org mpl", 0.97),
    ("mpl-11", "mpl-1.1", 70, "mozilla public license version 1 1", r" the contents of this file are subject to the mozilla public license version 1 1", 0.97),
    ("mpl-original", "mpl", 56, "initial developer of the original code", r" the (?:license )?initial developer of the original code is", 0.75),
    ("mpl-incompatible", "mpl", 60, "incompatible with secondary licenses", r" this source code form is incompatible with secondary licenses as defined by the mozilla public license", 0.96),
    ("mpl-covered", "mpl", 57, "covered software is provided under this license", r" covered software is provided under this license on an as is basis", 0.9),
    ("npl", "npl", 62, "netscape public license", r" subject to the netscape public license version 1 [01]", 0.95),
    ("epl-accompanying", "epl", 70, "eclipse public license", r" this program and the accompanying materials are made available under the terms of the eclipse public license", 0.97),
    ("epl-agreement", "epl", 64, "eclipse public license", r" the accompanying program is provided under the terms of this eclipse public license", 0.96),
    ("epl-reproduction", "epl", 58, "agreement", r" any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", 0.8),
    ("edl", "edl", 62, "eclipse distribution license", r" eclipse distribution license (?:version |v )?1 0", 0.93),
    ("cpl", "cpl", 62, "common public license", r" (?:terms of (?:the|this) )?common public license (?:version |v )?(?:0 5|1 0)", 0.93),
    ("ipl", "ipl", 62, "ibm public license", r" ibm public license (?:version )?1 0", 0.93),
    ("cddl-subject", "cddl", 70, "common development and distribution license", r" the contents of this file are subject to the terms of the common development and distribution license", 0.97),
    ("cddl-usr", "cddl", 58, "opensolaris license", r" you can obtain a copy of the license at usr src opensolaris license", 0.93),
    ("cddl-header", "cddl", 60, "when distributing covered code include this cddl header notice in each file and include the license file", r" when distributing covered code include this cddl header notice in each file and include the license file", 0.93),
    ("cddl-choice", "cddl", 56, "cddl license", r" cddl license", 0.8),
    ("cc-by-legal", "cc-by", 62, "creative commons", r" this work is licensed under (?:the |a )?creative commons attribution (?:[1-4] [0-9] )?(?:international |unported |generic )?license", 0.95),
    ("cc-sa-legal", "cc-by-sa", 66, "creative commons", r" this work is licensed under (?:the |a )?creative commons attribution share ?alike (?:[1-4] [0-9] )?(?:international |unported |generic )?license", 0.96),
    ("cc-nc-legal", "cc-by-nc", 66, "creative commons", r" this work is licensed under (?:the |a )?creative commons attribution non ?commercial (?:[1-4] [0-9] )?(?:international |unported |generic )?license", 0.96),
    ("cc-nc-sa-legal", "cc-by-nc-sa", 68, "creative commons", r" creative commons attribution non ?commercial share ?alike (?:[1-4] [0-9] )?(?:international |unported |generic )?license", 0.96),
    ("cc-nc-nd-legal", "cc-by-nc-nd", 68, "creative commons", r" creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? (?:[1-4] [0-9] )?(?:international |unported |generic )?license", 0.96),
    ("cc-nd-legal", "cc-by-nd", 66, "creative commons", r" this work is licensed under (?:the |a )?creative commons attribution no ?deriv(?:ative)?s (?:[1-4] [0-9] )?(?:international |unported |generic )?license", 0.96),
    ("cc-url-nc-sa", "cc-by-nc-sa", 62, "creativecommons", r" creativecommons org licenses by nc sa [0-9]+ [0-9]+", 0.97),
    ("cc-url-nc-nd", "cc-by-nc-nd", 62, "creativecommons", r" creativecommons org licenses by nc nd [0-9]+ [0-9]+", 0.97),
    ("cc0-waive", "cc0", 66, "copyright and related", r" to the extent possible under law [a-z0-9 ]{1,80} has waived all copyright and related or neighboring rights", 0.96),
    ("cc0-affirmer", "cc0", 64, "affirmer s copyright", r" permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights", 0.96),
    ("cc-summary", "cc-by", 50, "substitute for the license", r" this is a human readable summary of and not a substitute for the license", 0.8),
    ("cc-exercising", "cc-by", 58, "public license", r" by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution(?: 4 0 international)? public license", 0.95),
    ("pd-mark", "public-domain", 45, "public", r" creative ?commons (?:org )?public ?domain mark", 0.85),
    ("pd-gov", "public-domain", 50, "public domain in the united states", r" (?:works? of the (?:u s|united states) government|this file) (?:is|are) in the public domain in the united states", 0.9),
    ("pd-copyright", "public-domain", 46, "disclaims copyright", r" the author disclaims copyright to this source code", 0.92),
    ("pd-blessing", "public-domain", 48, "in place of a legal notice here is a blessing", r" in place of a legal notice here is a blessing(?: may you do good and not evil)?(?: the author disclaims copyright)", 0.9),
    ("unlicense-anyone", "unlicense", 64, "distribute this software", r" anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("unlicense-dedicate", "unlicense", 64, "public domain", r" the author or authors of this software dedicate any and all copyright interest in the software to the public domain", 0.97),
    ("unlicense-relinquish", "unlicense", 62, "copyright law", r" overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law", 0.97),
    ("unlicense-url", "unlicense", 58, "unlicense org", r" (?:http |https )?(?:www )?unlicense org", 0.9),
    ("wtfpl-terms", "wtfpl", 66, "what the fuck you want to public license", r" do what the fuck you want to public license terms and conditions for copying distribution and modification", 0.98),
    ("zlib-grant", "zlib", 68, "permission is granted to anyone", r" permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 0.97),
    ("zlib-origin", "zlib", 64, "misrepresented", r" the origin of this software must not be misrepresented you must not claim that you wrote the original software(?: if you use this software in a product an acknowledg(?:e)?ment in the product documentation would be appreciated)?", 0.9),
    ("zlib-notice", "zlib", 60, "this notice may not be removed or altered from any source distribution", r" (?:license )?this notice may not be removed or altered from any source distribution", 0.9),
    ("zlib-warranty", "zlib", 55, "implied warranty", r" this software is provided as is without any express or implied warranty", 0.75),
    ("libpng", "libpng", 64, "png reference library license", r" png reference library license version", 0.95),
    ("libtiff", "libtiff", 60, "copyright notices and this permission notice", r" provided that the above copyright notices and this permission notice appear in all copies of the software", 0.9),
    ("boost-grant", "boost", 68, "obtaining a copy of the software and accompanying documentation covered by this license", r" permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.97),
    ("boost-distributed", "boost", 64, "boost software license", r" distributed under the boost software license version 1 0", 0.97),
    ("boost-machine", "boost", 58, "unless such copies or derivative works are solely in the form of machine executable object code", r" unless such copies or derivative works are solely in the form of machine executable object code(?: generated by a source language processor)?", 0.85),
    ("artistic-intent", "artistic", 64, "copyright holder", r" the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 0.96),
    ("artistic-package", "artistic", 60, "this package is provided by the copyright holder and contributors as is", r" this package is provided by the copyright holder and contributors as is [a-z ]{0,60}", 0.5),
    ("artistic-same", "artistic", 60, "same terms as perl", r" (?:license )?(?:you can|you may) redistribute it and or modify it under the same terms as perl itself", 0.9),
    ("artistic-everyone", "artistic", 62, "everyone is permitted to copy and distribute verbatim copies of this license document", r" everyone is permitted to copy and distribute verbatim copies of this license document [a-z ]{0,60}preamble this license establishes the terms under which a given free software package", 0.93),
    ("ofl-copyright", "ofl", 66, "this license is", r" this license is (?:also )?(?:copied below and is )?(?:also )?available with a faq at", 0.8),
    ("ofl-reserved", "ofl", 62, "reserved font name", r" (?:copyright [a-z0-9 ]{1,80} )?with reserved font name", 0.85),
    ("ofl-goals", "ofl", 62, "open font license ofl", r" the goals of the open font license ofl are to stimulate worldwide development", 0.97),
    ("ofl-sold", "ofl", 60, "font software", r" (?:license )?neither the font software nor any of its individual components [a-z ]{0,60}may be sold by itself", 0.93),
    ("psf-group", "psf", 64, "license agreement is between the python software foundation", r" this license agreement is between the python software foundation psf and the individual or organization", 0.97),
    ("psf-beopen", "psf", 60, "beopen python open source license agreement version 1", r" beopen python open source license agreement version 1", 0.96),
    ("psf-cnri", "psf", 60, "license agreement", r" cnri (?:open source )?license agreement", 0.9),
    ("psf-retained", "psf", 56, "psf s license agreement", r" provided however that psf s license agreement and psf s notice of copyright", 0.95),
    ("php-name", "php", 62, "permission", r" the name php must not be used to endorse or promote products derived from this software without prior written permission", 0.96),
    ("php-source", "php", 60, "of the php license", r" this source file is subject to version 3 0?1? ?of the php license", 0.96),
    ("php-acknowledge", "php", 58, "includes php software", r" this product includes php software freely available from", 0.9),
    ("ruby-terms", "ruby", 58, "ruby s license", r" (?:copied|distributed|modified) (?:[a-z ]{0,40})?under (?:the terms of )?(?:the )?ruby s license", 0.92),
    ("ruby-place", "ruby", 56, "public domain or otherwise", r" place your modifications in the public domain or otherwise make them freely available", 0.75),
    ("ms-pl-body", "ms-pl", 62, "microsoft public license ms pl", r" microsoft public license ms pl this license governs use of the accompanying software", 0.97),
    ("ms-rl-body", "ms-rl", 62, "microsoft reciprocal license ms rl", r" microsoft reciprocal license ms rl this license governs use of the accompanying software", 0.97),
    ("ms-governs", "ms-pl", 55, "license governs use", r" this license governs use of the accompanying software if you use the software you accept this license", 0.8),
    ("ms-eula", "proprietary", 40, "microsoft software license terms", r" microsoft software license terms", 0.85),
    ("osl-licensed", "osl", 62, "open software license version", r" licensed under the open software license version (?:1 0|2 0|2 1|3 0)", 0.96),
    ("osl-applies", "osl", 58, "open software license", r" this open software license the license applies to any original work of authorship", 0.96),
    ("afl-licensed", "afl", 62, "academic free license version", r" licensed under the academic free license version (?:1 2|2 0|2 1|3 0)", 0.96),
    ("afl-applies", "afl", 58, "academic free license", r" this academic free license the license applies to any original work of authorship", 0.96),
    ("ecl-licensed", "ecl", 62, "educational community license version", r" licensed under the educational community license version (?:1 0|2 0)", 0.96),
    ("ncsa-grant", "ncsa", 64, "university of illinois open source license", r" (?:illinois )?university of illinois open source license", 0.9),
    ("odbl-available", "odbl", 62, "open database license", r" (?:is )?made available under the open database license", 0.96),
    ("odbl-contents", "odbl", 60, "database contents license", r" any rights in individual contents of the database are licensed under the database contents license", 0.97),
    ("odc-by", "odc-by", 60, "open data commons attribution license", r" open data commons attribution license", 0.95),
    ("pddl", "pddl", 60, "public domain dedication and license", r" open data commons public domain dedication and license", 0.95),
    ("upl-subject", "upl", 62, "universal permissive license", r" subject to the condition set forth below permission is hereby granted [a-z ]{0,160}universal permissive license", 0.9),
    ("upl-larger", "upl", 60, "any piece of software and or hardware listed in the lrgrwrks", r" (?:license )?any piece of software and or hardware listed in the lrgrwrks", 0.9),
    ("eupl-work", "eupl", 64, "licensed under the eupl", r" licensed under the eupl(?: version)? (?:v )?1 [0-2]", 0.97),
    ("eupl-except", "eupl", 58, "compliance with the licence", r" you may not use this work except in compliance with the licence", 0.93),
    ("cecill", "cecill", 60, "cecill", r" (?:governed by the |under the )?cecill(?: [abc])? licen[cs]e", 0.9),
    ("ceciill-copy", "cecill", 56, "abiding by the rules of distribution of free software", r" (?:licen[cs]e )?abiding by the rules of distribution of free software", 0.85),
    ("sleepycat", "sleepycat", 62, "redistributions in any form", r" redistributions in any form must be accompanied by information on how to obtain complete source code", 0.95),
    ("openssl-ack", "openssl", 62, "this product includes software developed by the openssl project", r" this product includes software developed by the openssl project(?: for use in the openssl toolkit)?(?: [a-z ]{0,40}permission)?", 0.9),
    ("openssl-name", "openssl", 60, "permission", r" products derived from this software may not be called openssl nor may openssl appear in their names without prior written permission", 0.95),
    ("ssleay", "openssl", 58, "software written by eric young", r" this product includes (?:cryptographic )?software written by eric young(?: [a-z ]{0,40}copyright)?", 0.85),
    ("postgresql", "postgresql", 64, "without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", r" without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", 0.97),
    ("tcl", "tcl", 60, "license", r" the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 0.96),
    ("unicode-dfs", "unicode", 62, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", r" permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 0.97),
    ("icu", "icu", 58, "icu license", r" icu license icu 1 8 1 and later", 0.96),
    ("w3c-notice", "w3c", 62, "license", r" w3c software (?:and document )?(?:notice and )?license", 0.94),
    ("w3c-shall", "w3c", 58, "licensee", r" by obtaining (?:using and or copying )?this work you the licensee agree that you have read understood and will comply", 0.95),
    ("json-evil", "json", 66, "software shall be used for good", r" (?:copyright )?(?:the )?software shall be used for good not evil", 0.97),
    ("vim", "vim", 60, "vim license", r" (?:this program is )?(?:distributed )?under the (?:terms of the )?vim license", 0.92),
    ("beerware-revision", "beerware", 68, "beer ware license", r" the beer ware license revision 42", 0.98),
    ("beerware-meet", "beerware", 64, "beer", r" if we meet some day and you think this stuff is worth it you can buy me a beer", 0.97),
    ("sspl", "sspl", 64, "server side public license", r" server side public license (?:version |v )?1", 0.95),
    ("busl", "busl", 64, "business source license", r" business source license (?:version )?1 1", 0.95),
    ("busl-change", "busl", 60, "change license", r" (?:on the )?change date [a-z0-9 ]{0,80}change license", 0.85),
    ("elastic", "elastic", 64, "elastic license", r" elastic license (?:version |v )?(?:1 0|2 0)", 0.94),
    ("elastic-hosted", "elastic", 60, "you may not provide the software to third parties as a hosted or managed service", r" you may not provide the software to third parties as a hosted or managed service(?: [a-z ]{0,200}licensor)?", 0.92),
    ("commons-clause", "commons-clause", 64, "commons clause license condition", r" (?:the )?commons clause license condition v1 0", 0.96),
    ("polyform", "polyform", 62, "license", r" polyform (?:noncommercial|small business|shield|strict|perimeter) license", 0.95),
    ("hippocratic", "hippocratic", 60, "hippocratic license", r" hippocratic license (?:version )?[0-9]", 0.94),
    ("openrail", "openrail", 60, "licen", r" (?:creativeml )?(?:bigscience )?open ?rail (?:m )?licen[cs]e", 0.93),
    ("llama", "llama", 60, "community license agreement", r" llama [0-9 ]{0,4}community license agreement", 0.96),
    ("sun-bcl", "proprietary", 42, "binary code license", r" (?:sun microsystems |oracle )?(?:inc )?binary code license agreement", 0.9),
    ("eula", "proprietary", 38, "end user license agreement", r" end user license agreement", 0.8),
    ("eula-accept", "proprietary", 40, "license agreement", r" by (?:installing|using|downloading|clicking) [a-z ]{0,60}you (?:agree to|accept) (?:be bound by )?the terms of this (?:end user )?license agreement", 0.85),
    ("prop-reverse", "proprietary", 36, "reverse engineer", r" (?:license )?you may not (?:modify |copy )?(?:decompile |disassemble )?(?:or )?reverse engineer", 0.75),
    ("prop-trade", "proprietary", 32, "trade secret", r" contains (?:confidential information and )?trade secrets? (?:of|and confidential) [a-z]+", 0.6),
    ("prop-internal", "proprietary", 34, "internal use only", r" (?:license )?for internal use only", 0.6),
    ("prop-transmitted", "proprietary", 30, "permission of the publisher", r" (?:stored in a retrieval system or )?transmitted in any form [a-z ]{0,140}without (?:the )?(?:prior )?(?:written )?permission of the publisher", 0.85),
    ("prop-unauthorized", "proprietary", 32, "unauthorized copying", r" unauthorized copying of this file via any medium is strictly prohibited", 0.93),
    ("prop-nda", "proprietary", 34, "disclosure agreement", r" (?:subject to|covered by|under) (?:a )?non ?disclosure agreement", 0.6),
    ("non-commercial", "non-commercial", 40, "non commercial use", r" for (?:personal and )?non commercial use only", 0.75),
    ("dual-licence", "dual", 36, "dual licensed", r" (?:is )?dual licensed under(?: the)?", 0.7),
    ("copyright-all", "copyright", 12, "copyright", r" copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])? [a-z]+ [a-z]+ all rights reserved", 0.6),
    ("copyright-by", "copyright", 11, "copyright", r" copyright by [a-z]+ [a-z]+", 0.4),
    ("used-permission", "proprietary", 20, "used by permission", r" used by permission(?: all rights reserved)?", 0.5),
    ("reprinted", "proprietary", 22, "permission", r" reprinted with (?:the )?permission (?:of|from)", 0.7),
    ("moral-rights", "proprietary", 18, "moral right", r" (?:copyright )?the moral rights? of the author (?:has|have) been asserted", 0.85),
)


def _keyword(regex: str) -> bytes:
    """The longest plain run of a regex: every match contains it."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??|\[[^]]*\]\+?\??", "\0", regex)
    return max(plain.split("\0"), key=len).encode()


def _rules() -> tuple[Rule, ...]:
    out = [Rule(f"base-{label}", label, 1, phrase.encode(), re.compile(f" {phrase}(?= )".encode()), 0.6) for phrase, label in BASE]
    for label, (names, tags) in _LICENSES.items():
        for form, pattern, priority, keyword, weight in _FORMS:
            for i, value in enumerate(names if "N" in pattern else tags):
                regex = pattern.replace("N", re.escape(value).replace(r"\ ", " ")) if "N" in pattern else pattern.replace("T", value)
                gate = value if len(value) > len(keyword) and "N" in pattern else keyword
                # a longer name is the more exact signature
                out.append(Rule(f"{label}-{form}-{i}", label, priority + min(9, len(value) // 8), gate.encode(), re.compile(f"{regex}(?= )".encode()), weight))
    out += [Rule(name, label, priority, keyword.encode(), re.compile(f"{regex}(?= )".encode()), weight) for name, label, priority, keyword, regex, weight in _SINGLE]
    return tuple(sorted(out, key=lambda r: (-r.priority, r.name)))


RULES = _rules()
#: A text without any of these has no match of any rule (checked in the tests).
ANCHORS: tuple[bytes, ...] = (
    b"licen", b"copyright", b"permi", b"public", b"gnu", b"gpl", b"apache", b"mozilla", b"redistrib", b"compliance",
    b"source versions", b"rights reserved", b"creative", b"cc0", b"advertising", b"endorse", b"boost", b"eclipse", b"beer",
    b"confidential", b"reproduced", b"fuck", b"free software", b"hope that", b"as is", b"in the software", b"written author",
    b"warrant", b"following acknowledg", b"carry prominent notices", b"later version", b"installation information", b"font",
    b"linking exception", b"combined work", b"computer network", b"original code", b"distribut", b"legal notice",
    b"misrepresented", b"derivative works", b"php software", b"lrgrwrks", b"software developed", b"software written",
    b"shall be used for", b"hosted or managed", b"reverse engineer", b"trade secret", b"internal use only", b"unauthorized",
    b"agreement", b"moral right", b"non commercial")
