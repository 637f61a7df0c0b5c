"""Signature rules of the license scan, one a line: label | priority | confidence | pattern.

A pattern is a regular expression over normalised words (ASCII lower case, one space between words). @ stands before its
anchor word; ~N stands for up to N words. Priority 1: mentions; 2: names with versions, notices; 3: grants, identifiers
and headers; 4: clauses of a license text. A rule is tried only around its anchor, and only where the longest plain piece of its
pattern stands there (its keyword).
"""

from __future__ import annotations

import re

HAND_WRITTEN = """
mit | 4 | 1.0 | permission is @hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 4 | 0.9 | without restriction including without limitation the rights to use copy modify merge publish distribute @sublicense and or sell copies
mit | 4 | 0.8 | the above @copyright notice and this permission notice shall be included in all copies or substantial portions
mit | 3 | 0.9 | (?:distributed|released|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit (?:style |open source )?@licen[cs]e
mit | 2 | 0.7 | mit style @licen[cs]e
mit-0 | 3 | 0.95 | mit no @attribution
mit-0 | 2 | 0.8 | mit 0 @licen[cs]e
x11 | 2 | 0.8 | x11 @licen[cs]e
x11 | 4 | 0.8 | except as contained in this notice the name of the x @consortium shall not be used
hpnd | 4 | 0.8 | appear in supporting documentation and that the name of ~6 not be used in advertising or @publicity
ntp | 3 | 0.8 | (?:the )?ntp @licen[cs]e
isc | 4 | 0.95 | @permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 4 | 0.7 | the software is provided as is and the author disclaims all @warranties with regard to this software
0bsd | 2 | 0.9 | @0bsd
0bsd | 2 | 0.9 | zero clause bsd @licen[cs]e
bsd | 4 | 0.9 | @redistribution and use in source and binary forms with or without modification are permitted
bsd | 4 | 0.7 | @redistributions of source code must retain the above copyright notice
bsd | 4 | 0.7 | @redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 4 | 0.95 | neither the name of ~20 may be used to @endorse or promote products derived from this software
bsd-3-clause | 4 | 0.95 | neither the name of ~12 nor the names of its @contributors may be used
bsd-4-clause | 4 | 0.95 | all @advertising materials mentioning features or use of this software must display
bsd-2-clause | 2 | 0.9 | two clause bsd @licen[cs]e
bsd-3-clause | 2 | 0.9 | three clause bsd @licen[cs]e
bsd-3-clause | 2 | 0.85 | revised bsd @licen[cs]e
bsd-3-clause | 2 | 0.85 | modified bsd @licen[cs]e
bsd-4-clause | 2 | 0.9 | original bsd @licen[cs]e
bsd-2-clause | 2 | 0.9 | freebsd @licen[cs]e
bsd | 2 | 0.7 | bsd style @licen[cs]e
bsd | 3 | 0.85 | use of this source code is governed by a bsd style @licen[cs]e
bsd | 2 | 0.7 | berkeley software distribution @licen[cs]e
apache-2.0 | 3 | 1.0 | @licensed under the apache license version 2 0
apache-2.0 | 3 | 0.95 | you may not use this file except in compliance with the @license
apache-2.0 | 3 | 0.95 | www apache org @licenses license 2 0
apache-2.0 | 3 | 0.7 | on an as is basis without @warranties or conditions of any kind either express or implied
apache-2.0 | 4 | 0.9 | apache @license version 2 0 ~12 terms and conditions for use reproduction and distribution
apache-2.0 | 2 | 0.9 | asl 2 0 @licen[cs]e
apache-2.0 | 3 | 0.9 | (?:under )?(?:the )?apache 2 0 @licen[cs]e
apache-1.1 | 2 | 0.9 | apache software @license version 1 1
apache-1.0 | 2 | 0.9 | apache @license version 1 0
apache-llvm-exception | 3 | 0.95 | apache @license v2 0 with llvm exceptions
gpl-or-later | 3 | 0.95 | general public @license ~60 any later version
gpl | 3 | 0.95 | you can @redistribute it and or modify it under the terms of the gnu general public license
gpl-2 | 3 | 0.95 | general public @license ~16 either version 2 of the license
gpl-3 | 3 | 0.95 | general public @license ~16 either version 3 of the license
gpl-2-only | 3 | 0.95 | general public @license ~4 version 2 only
gpl-2-only | 3 | 0.95 | general public @license version 2 as published by the free software foundation
gpl-3-only | 3 | 0.95 | general public @license ~4 version 3 only
gpl | 3 | 0.8 | you should have received a copy of the gnu general public @license
gpl | 4 | 0.95 | everyone is permitted to copy and distribute verbatim copies of this @license document
gpl | 4 | 0.8 | when we speak of free software we are referring to freedom not price ~20 our general public @licenses
gpl-2 | 4 | 0.9 | gnu general public @license version 2 june 1991
gpl-3 | 4 | 0.9 | gnu general public @license version 3 29 june 2007
gpl-1 | 4 | 0.9 | gnu general public @license version 1 february 1989
gpl | 3 | 0.8 | (?:released|distributed|licensed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?@gpl
gpl-2 | 2 | 0.9 | (?:gnu )?@gpl (?:v|version )?2(?: 0)?
gpl-3 | 2 | 0.9 | (?:gnu )?@gpl (?:v|version )?3(?: 0)?
gpl-2 | 2 | 0.9 | @gplv2
gpl-3 | 2 | 0.9 | @gplv3
gpl-2-or-later | 2 | 0.9 | @gplv2 or (?:any )?later
gpl-3-or-later | 2 | 0.9 | @gplv3 or (?:any )?later
gpl-classpath-exception | 3 | 0.95 | with (?:the )?(?:gnu )?classpath @exception
gpl-linking-exception | 3 | 0.9 | with (?:a |the )?(?:special )?linking @exception
gpl-linking-exception | 4 | 0.9 | as a special @exception ~12 permission to link
gpl-font-exception | 3 | 0.9 | with (?:the )?(?:gpl )?font @exception
gpl-gcc-exception | 4 | 0.95 | gcc runtime library @exception
gpl-autoconf-exception | 4 | 0.9 | as a special @exception ~40 autoconf
gpl-bison-exception | 4 | 0.9 | as a special @exception ~30 bison parser skeleton
openssl-exception | 3 | 0.9 | @exception ~30 openssl library
lgpl | 3 | 0.95 | @redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1 | 3 | 0.95 | lesser general public @license ~16 version 2 1 of the license
lgpl-3 | 3 | 0.95 | lesser general public @license ~16 version 3 of the license
lgpl-2.1 | 4 | 0.9 | gnu lesser general public @license version 2 1 february 1999
lgpl-3 | 4 | 0.9 | gnu lesser general public @license version 3 29 june 2007
lgpl-2 | 4 | 0.9 | gnu library general public @license version 2 june 1991
lgpl-2.1 | 2 | 0.9 | @lgplv2 1
lgpl-3 | 2 | 0.9 | @lgplv3
lgpl | 2 | 0.8 | (?:gnu )?@lgpl (?:v|version )?[23](?: [0-9])?
lgpl | 3 | 0.8 | received a copy of the gnu lesser general public @license
agpl-3 | 3 | 0.95 | affero general public @license ~16 version 3
agpl-3 | 4 | 0.9 | gnu affero general public @license version 3 19 november 2007
agpl | 3 | 0.95 | @redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3 | 2 | 0.9 | @agplv3
agpl | 2 | 0.8 | (?:gnu )?@agpl (?:v|version )?3(?: 0)?
agpl | 4 | 0.9 | remote network interaction use with the gnu general public @license
gfdl | 3 | 0.95 | @permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 2 | 0.8 | @gfdl (?:v|version )?1 [0-3]
gfdl-invariants | 3 | 0.9 | free documentation @license ~30 no invariant sections
mpl-2.0 | 3 | 1.0 | subject to the terms of the mozilla public @license v 2 0
mpl-2.0 | 3 | 0.95 | mozilla org @mpl 2 0
mpl-2.0 | 2 | 0.9 | @mpl 2 0
mpl-1.1 | 3 | 0.95 | subject to the mozilla public @license version 1 1
mpl-1.0 | 3 | 0.95 | subject to the mozilla public @license version 1 0
mpl-tri-license | 4 | 0.9 | version mpl 1 1 @gpl 2 0 lgpl 2 1
mpl-2.0-no-copyleft | 4 | 0.9 | incompatible with secondary @licenses
epl-2.0 | 3 | 0.95 | eclipse public @license (?:v|version) 2 0
epl-1.0 | 3 | 0.95 | eclipse public @license (?:v1 0|v 1 0|version 1 0)
epl | 3 | 0.95 | accompanying materials are made available under the terms of the eclipse public @license
edl | 2 | 0.9 | eclipse distribution @license
cddl-1.0 | 3 | 0.95 | common development and distribution @license ~6 version 1 0
cddl-1.1 | 3 | 0.95 | common development and distribution @license ~6 version 1 1
cddl | 3 | 0.9 | subject to the terms of the common development and distribution @license
cpl-1.0 | 2 | 0.9 | common public @license version 1 0
cpal | 2 | 0.9 | common public @attribution license
ipl-1.0 | 2 | 0.9 | ibm public @license version 1 0
zlib | 4 | 0.95 | in no event will the authors be held @liable for any damages arising from the use of this software
zlib | 4 | 0.9 | the origin of this software must not be @misrepresented
zlib | 2 | 0.85 | zlib libpng @license
libpng | 2 | 0.85 | libpng @license
bsl-1.0 | 4 | 1.0 | boost software @license version 1 0
bsl-1.0 | 3 | 0.95 | boost org @license 1 0 txt
artistic-2.0 | 2 | 0.9 | artistic @license (?:version )?2 0
artistic-1.0 | 2 | 0.9 | artistic @license (?:version )?1 0
perl | 3 | 0.95 | (?:redistribute it and or modify it )?under the same terms as @perl itself
python-2.0 | 2 | 0.9 | psf @license agreement
python-2.0 | 4 | 0.9 | python software foundation @license version 2
cnri-python | 4 | 0.9 | cnri ~6 @license agreement
afl-3.0 | 2 | 0.9 | academic free @license (?:v|version )?3 0
osl-3.0 | 2 | 0.9 | open software @license (?:v|version )?3 0
ecl-2.0 | 2 | 0.9 | educational community @license
upl-1.0 | 2 | 0.9 | universal permissive @license
ncsa | 2 | 0.9 | university of illinois (?:ncsa )?open source @license
postgresql | 2 | 0.9 | postgresql @licen[cs]e
postgresql | 4 | 0.85 | without fee and without a written agreement is @hereby granted
curl | 2 | 0.85 | curl @license
openssl | 4 | 0.95 | this product includes software developed by the openssl project for use in the openssl @toolkit
ssleay | 4 | 0.95 | this product includes cryptographic software written by @eric young
json | 4 | 1.0 | the software shall be used for good not @evil
wtfpl | 4 | 1.0 | do what the fuck you want to public @license
wtfpl | 2 | 0.9 | @wtfpl
beerware | 4 | 1.0 | you can buy me a @beer in return
beerware | 2 | 0.9 | @beerware
unlicense | 4 | 1.0 | this is free and unencumbered software released into the public @domain
unlicense | 3 | 0.95 | @unlicense org
unlicense | 2 | 0.8 | @unlicense
cc0-1.0 | 3 | 1.0 | creativecommons org @publicdomain zero 1 0
cc0-1.0 | 3 | 0.95 | @cc0 1 0 universal
cc0 | 3 | 0.95 | @licensed under (?:a )?creative commons zero
cc0 | 2 | 0.9 | @cc0 (?:1 0|licen[cs]e|dedication|waiver)
cc0 | 4 | 0.9 | waives all ~12 @copyright and related rights
pdm | 3 | 0.9 | creativecommons org @publicdomain mark 1 0
public-domain | 2 | 0.8 | (?:in|into|to) the public @domain
public-domain | 3 | 0.9 | (?:hereby )?(?:placed|dedicated|released|put) (?:in|into|to) the public @domain
public-domain | 3 | 0.9 | no @copyright is claimed
public-domain | 2 | 0.7 | free of known @copyright restrictions
cc-by-4.0 | 3 | 1.0 | creativecommons org @licenses by 4 0
cc-by-3.0 | 3 | 1.0 | creativecommons org @licenses by 3 0
cc-by-2.0 | 3 | 1.0 | creativecommons org @licenses by 2 0
cc-by-sa-4.0 | 3 | 1.0 | creativecommons org @licenses by sa 4 0
cc-by-sa-3.0 | 3 | 1.0 | creativecommons org @licenses by sa 3 0
cc-by-sa-2.5 | 3 | 1.0 | creativecommons org @licenses by sa 2 5
cc-by-nc-4.0 | 3 | 1.0 | creativecommons org @licenses by nc 4 0
cc-by-nc-3.0 | 3 | 1.0 | creativecommons org @licenses by nc 3 0
cc-by-nd-4.0 | 3 | 1.0 | creativecommons org @licenses by nd 4 0
cc-by-nc-sa-4.0 | 3 | 1.0 | creativecommons org @licenses by nc sa 4 0
cc-by-nc-sa-3.0 | 3 | 1.0 | creativecommons org @licenses by nc sa 3 0
cc-by-nc-nd-4.0 | 3 | 1.0 | creativecommons org @licenses by nc nd 4 0
cc-by-nc-nd-3.0 | 3 | 1.0 | creativecommons org @licenses by nc nd 3 0
cc-by-4.0 | 3 | 0.95 | @licen[cs]ed under (?:a |the )?cc by 4 0
cc-by-sa-4.0 | 3 | 0.95 | @licen[cs]ed under (?:a |the )?cc by sa 4 0
cc-by-sa-3.0 | 3 | 0.95 | @licen[cs]ed under (?:a |the )?cc by sa 3 0
cc-by-nc-4.0 | 3 | 0.95 | @licen[cs]ed under (?:a |the )?cc by nc 4 0
cc-by-nc-sa-4.0 | 3 | 0.95 | @licen[cs]ed under (?:a |the )?cc by nc sa 4 0
cc-by-nd-4.0 | 3 | 0.95 | @licen[cs]ed under (?:a |the )?cc by nd 4 0
cc-by-nc-nd-4.0 | 3 | 0.95 | @licen[cs]ed under (?:a |the )?cc by nc nd 4 0
cc-by | 2 | 0.8 | cc by @licen[cs]e
cc-by-sa-4.0 | 3 | 0.95 | creative commons @attribution sharealike 4 0 international
cc-by-sa-3.0 | 3 | 0.95 | creative commons @attribution sharealike 3 0 unported
cc-by-4.0 | 3 | 0.95 | creative commons @attribution 4 0 international
cc-by-3.0 | 3 | 0.95 | creative commons @attribution 3 0 unported
cc-by-nc-4.0 | 3 | 0.95 | creative commons @attribution non ?commercial 4 0 international
cc-by-nc-sa-4.0 | 3 | 0.95 | creative commons @attribution non ?commercial sharealike 4 0 international
cc-by-nc-nd-4.0 | 3 | 0.95 | creative commons @attribution non ?commercial no ?derivatives 4 0 international
cc-by-nd-4.0 | 3 | 0.95 | creative commons @attribution no ?derivatives 4 0 international
cc-sampling | 2 | 0.8 | creative commons sampling plus @licen[cs]e
odbl-1.0 | 3 | 0.95 | open database @license (?:odbl )?(?:v|version )?1 0
odbl-1.0 | 3 | 0.9 | opendatacommons org @licenses odbl
odc-by-1.0 | 3 | 0.9 | opendatacommons org @licenses by
odc-pddl | 3 | 0.9 | public @domain dedication and licen[cs]e
cdla-permissive | 2 | 0.9 | community data @license agreement permissive
cdla-sharing | 2 | 0.9 | community data @license agreement sharing
ogl-uk-3.0 | 3 | 0.95 | open government @licen[cs]e v3 0
ogl | 2 | 0.85 | open government @licen[cs]e
etalab | 2 | 0.85 | @licence ouverte
gutenberg | 4 | 0.95 | under the terms of the project gutenberg @license included
gutenberg | 2 | 0.8 | (?:full )?project gutenberg (?:tm )?@license
ofl-1.1 | 3 | 1.0 | sil open font @license version 1 1
ofl | 4 | 0.9 | with reserved font name ~12 @licensed
ufl | 2 | 0.9 | ubuntu font @licen[cs]e
eupl-1.2 | 2 | 0.95 | @eupl (?:v|version )?1 2
eupl | 3 | 0.95 | @licensed under the eupl
ms-pl | 4 | 0.9 | microsoft public @license ms pl
ms-rl | 4 | 0.9 | microsoft reciprocal @license ms rl
cecill | 2 | 0.9 | @cecill (?:free software )?(?:licen[cs]e|v?[12])
cecill | 4 | 0.9 | governed by the cecill ~3 @license under french law
lppl | 2 | 0.9 | latex project public @license
ofl | 2 | 0.8 | open font @license
w3c | 2 | 0.9 | w3c (?:software )?(?:notice and )?@license
vim | 2 | 0.85 | vim @license
sleepycat | 2 | 0.9 | sleepycat @license
qpl | 2 | 0.9 | q public @license
mulan-psl-2 | 2 | 0.95 | @mulan (?:psl|permissive software license)
mulan-psl-2 | 3 | 0.95 | @licensed under mulan psl v2
bsl-1.1 | 3 | 0.95 | business source @license (?:version )?1 1
busl-change-date | 4 | 0.95 | change date ~12 change @license
elastic-2.0 | 3 | 0.95 | elastic @license (?:v|version )?2 0
sspl-1.0 | 3 | 0.95 | server side public @license version 1
commons-clause | 4 | 1.0 | commons clause @license condition
polyform-noncommercial | 2 | 0.95 | polyform noncommercial @license
polyform-small-business | 2 | 0.95 | polyform small business @license
prosperity | 2 | 0.9 | prosperity public @license
parity | 2 | 0.9 | parity public @license
hippocratic | 2 | 0.95 | hippocratic @license
anti-996 | 2 | 0.95 | anti 996 @license
blueoak | 2 | 0.95 | blue oak model @license
llama-2 | 3 | 0.95 | llama 2 community @license
llama-3 | 3 | 0.95 | (?:meta )?llama 3(?: [0-9])? community @license
gemma | 3 | 0.9 | @gemma terms of use
openrail-m | 3 | 0.95 | (?:creativeml )?open rail m @license
bigscience-rail | 3 | 0.95 | bigscience (?:bloom )?rail @license
responsible-ai | 2 | 0.9 | responsible ai @license
nvidia | 2 | 0.85 | nvidia (?:software |open model )?@license
intel | 2 | 0.85 | intel simplified software @license
copyright-notice | 1 | 0.3 | @copyright (?:c )?(?:19|20)[0-9][0-9]
copyright-notice | 1 | 0.3 | @copyright (?:c )?(?:by )?the ~6 (?:authors|contributors|developers)
copyright-notice | 1 | 0.3 | @copyright (?:c )?all contributors
proprietary | 2 | 0.6 | @copyright ~60 all rights reserved
proprietary | 3 | 0.8 | confidential and @proprietary
proprietary | 3 | 0.8 | @proprietary ~20 trade secrets?
proprietary | 3 | 0.85 | unauthori[sz]ed (?:copying|use|reproduction|distribution) ~16 strictly @prohibited
proprietary | 3 | 0.8 | may not be (?:reproduced|copied|distributed) ~20 without (?:the )?(?:express )?prior written @permission
proprietary | 3 | 0.8 | @proprietary ~8 not for distribution
eula | 3 | 0.85 | end user @licen[cs]e agreement
eula | 3 | 0.85 | by installing ~30 agree to ~12 @license
eula | 2 | 0.7 | @eula
shareware | 2 | 0.7 | @shareware
freeware | 2 | 0.7 | @freeware
evaluation-only | 3 | 0.8 | @licensed ~6 for evaluation purposes only
non-commercial | 3 | 0.85 | (?:for )?(?:personal and )?non @commercial use only
non-commercial | 3 | 0.8 | @licensed ~10 non ?commercial purposes
academic-use | 3 | 0.8 | (?:for )?@academic (?:and research )?use only
research-only | 3 | 0.85 | (?:for )?@research purposes only
no-derivatives | 3 | 0.7 | no @derivative works
copyleft | 1 | 0.4 | @copyleft
patent-grant | 4 | 0.7 | (?:royalty free|irrevocable) ~4 patent @licen[cs]e
patent-retaliation | 4 | 0.7 | patent @litigation against any entity
warranty-disclaimer | 1 | 0.4 | without @warranty of any kind
warranty-disclaimer | 1 | 0.4 | without any @warranty ~12 (?:merchantability|fitness)
warranty-disclaimer | 1 | 0.4 | provided as is ~8 without ~6 @warranty
warranty-disclaimer | 1 | 0.4 | implied @warranties of merchantability
liability-disclaimer | 1 | 0.4 | in no event shall the ~12 be @liable
trademark-clause | 2 | 0.5 | does not grant ~6 @permission to use the trade names
dual-license | 2 | 0.7 | dual @licen[cs]ed(?: under)?
dual-license | 2 | 0.7 | under either ~20 @license ~6 at your option
spdx | 1 | 0.9 | @spdx licen[cs]e identifier [a-z0-9]+
"""

#: Forms that every family's name occurs in: form -> (pattern around the name N, priority, confidence, whether a version ends it)
FORMS = {
    "bare": ("N @licen[cs]e", 1, 0.7, False),
    "versioned": ("N @licen[cs]e (?:version |v )?[1-9](?: [0-9])?", 2, 0.9, True),
    "under": ("under (?:the )?(?:terms of )?(?:the )?N @licen[cs]e", 3, 0.95, False),
    "licensed under": ("@licen[cs]ed under (?:the )?(?:terms of )?(?:the )?N", 3, 0.95, False),
    "spdx": ("@spdx licen[cs]e identifier N", 3, 1.0, False),
}

#: name of a licence, as a pattern of normalised words -> label
FAMILIES = {
    "mit": "mit", "expat": "mit", "apache": "apache", "apache software": "apache",
    "(?:gnu )?general public": "gpl", "gpl": "gpl",
    "(?:gnu )?lesser general public": "lgpl", "(?:gnu )?library general public": "lgpl", "lgpl": "lgpl",
    "(?:gnu )?affero general public": "agpl", "agpl": "agpl", "(?:gnu )?free documentation": "gfdl",
    "bsd": "bsd", "2 clause bsd": "bsd-2-clause", "3 clause bsd": "bsd-3-clause", "new bsd": "bsd-3-clause", "simplified bsd": "bsd-2-clause",
    "mozilla public": "mpl", "mpl": "mpl", "eclipse public": "epl", "common development and distribution": "cddl",
    "common public": "cpl", "ibm public": "ipl", "isc": "isc", "zlib": "zlib", "boost software": "bsl", "artistic": "artistic",
    "perl artistic": "artistic", "python software foundation": "psf", "academic free": "afl", "open software": "osl",
    "microsoft public": "ms-pl", "microsoft reciprocal": "ms-rl", "european union public": "eupl", "sil open font": "ofl",
    "creative commons": "cc", "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "open data commons": "odc", "open database": "odbl", "php": "php", "ruby": "ruby", "openssl": "openssl", "server side public": "sspl",
    "business source": "busl", "elastic": "elastic", "llama community": "llama", "openrail": "openrail",
}

#: What is not plain in a pattern: groups, classes, characters that may be missing, gaps.
_NOT_PLAIN = re.compile(r"\(\?:[^()]*\)\??|\[[^\]]*\][+?]?|.\?|~\d+ ")


def _expanded(pattern: str) -> str:
    return "(?:^| )" + re.sub(r"~(\d+) ", r"(?:[^ ]+ ){0,\1}?", pattern) + "(?= |$)"


def reach(pattern: str) -> tuple[int, int]:
    """Words a pattern can match before its anchor, and from it on, at most."""
    left, right = ((part.count(" ") + sum(int(n) - 1 for n in re.findall(r"~(\d+) ", part))) for part in pattern.split("@"))
    return left, right + 1


def anchors(pattern: str) -> list[str]:
    """The words that a pattern's anchor can be."""
    word = re.search(r"@((?:\[[a-z]+\]|[a-z0-9]|\?)+)", pattern)[1]
    out = [""]
    for piece in re.findall(r"\[[a-z]+\]|[a-z0-9]\??", word):
        letters = piece.strip("[]") if piece[0] == "[" else piece[0]
        out = [o + c for o in out for c in letters] + (out if piece.endswith("?") else [])
    return out


def keyword(pattern: str) -> str:
    """The longest piece of a pattern that every match holds as it stands."""
    return max(_NOT_PLAIN.sub("\n", pattern).split("\n"), key=len)


def rules(text: str = HAND_WRITTEN) -> list[dict]:
    """Rules in their order: hand-written ones, then each form with each family's name."""
    out = []
    for line in text.strip().splitlines():
        label, priority, confidence, pattern = (x.strip() for x in line.split(" | "))
        out.append({"label": label, "priority": int(priority), "confidence": float(confidence), "pattern": pattern, "version": False})
    for pattern, priority, confidence, version in FORMS.values():
        for name, label in FAMILIES.items():
            out.append({"label": label, "priority": priority, "confidence": confidence, "pattern": pattern.replace("N", name), "version": version})
    for r in out:
        r["regex"], r["keyword"] = _expanded(r["pattern"]), keyword(r["pattern"])
        r["anchors"] = anchors(r["pattern"])
        r["left"], r["right"] = reach(r["pattern"])
    return out
