"""The signature rules of the license scan, written by hand.

A line is: label, priority, confidence, keyword, pattern, parted by `` :: ``. A space
in a pattern stands for any run of white space, `` ?`` for one that may lack; inside
brackets characters stand for themselves. The keyword (words parted by one space) is
part of every match once white space is evened out.

Priorities: 9 identifier tags, 8 headers that state the terms, 7 passages of the
license texts themselves, 5 grants by name ("licensed under ..."), 3 names, 2 short
names, 1 hints.
"""

RULES = r"""
gpl-3.0-or-later :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?gpl-3\.0(?:-or-later|\+)
gpl-3.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?gpl-3\.0(?:-only)?(?![+-])
gpl-2.0-or-later :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?gpl-2\.0(?:-or-later|\+)
gpl-2.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?gpl-2\.0(?:-only)?(?![+-])
gpl-1.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?gpl-1\.0(?:-only|-or-later|\+)?
lgpl-3.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?lgpl-3\.0(?:-only|-or-later|\+)?
lgpl-2.1 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?lgpl-2\.1(?:-only|-or-later|\+)?
lgpl-2.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?lgpl-2\.0(?:-only|-or-later|\+)?
agpl-3.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?agpl-3\.0(?:-only|-or-later|\+)?
gfdl :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?gfdl-1\.[123](?:-only|-or-later)?
apache-2.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?apache-2\.0
apache-1.1 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?apache-1\.1
apache-1.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?apache-1\.0
mit-0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?mit-0
mit :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?(?:mit|x11)(?!-)
bsd-0-clause :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?0bsd
bsd-2-clause :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?bsd-2-clause(?:-(?:patent|views))?
bsd-3-clause :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?bsd-3-clause(?:-(?:clear|lbnl))?
bsd-4-clause :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?bsd-4-clause(?:-uc)?
isc :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?isc
mpl-2.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?mpl-2\.0(?:-no-copyleft-exception)?
mpl-1.1 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?mpl-1\.1
epl-2.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?epl-2\.0
epl-1.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?epl-1\.0
cddl-1.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cddl-1\.[01]
eupl-1.2 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?eupl-1\.2
artistic-2.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?artistic-2\.0
bsl-1.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?bsl-1\.0
busl-1.1 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?busl-1\.1
zlib :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?zlib(?:-acknowledgement)?
unlicense :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?unlicense
cc0-1.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc0-1\.0
wtfpl :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?wtfpl
ofl-1.1 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?ofl-1\.1(?:-(?:no-)?rfn)?
psf-2.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?(?:psf|python)-2\.0
postgresql :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?postgresql
ms-pl :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?ms-pl
odbl-1.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?odbl-1\.0
cc-by-4.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc[ -]by[ -]4\.0
cc-by-3.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc[ -]by[ -]3\.0
cc-by-sa-4.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc[ -]by-sa[ -]4\.0
cc-by-sa-3.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc[ -]by-sa[ -]3\.0
cc-by-nc-4.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc[ -]by-nc[ -]4\.0
cc-by-nd-4.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc[ -]by-nd[ -]4\.0
cc-by-nc-sa-4.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc[ -]by-nc-sa[ -]4\.0
cc-by-nc-nd-4.0 :: 9 :: 0.99 :: spdx-license-identifier :: spdx-license-identifier: ?cc[ -]by-nc-nd[ -]4\.0
gpl-3.0-or-later :: 8 :: 0.97 :: terms of the gnu general public license :: (?:redistribute it and/or modify it )?under the terms of the gnu general public license as published by the free software foundation[,;]? either version 3 of the license, or \(at your option\) any later version
gpl-2.0-or-later :: 8 :: 0.97 :: terms of the gnu general public license :: (?:redistribute it and/or modify it )?under the terms of the gnu general public license as published by the free software foundation[,;]? either version 2 of the license, or \(at your option\) any later version
gpl-1.0-or-later :: 8 :: 0.97 :: terms of the gnu general public license :: under the terms of the gnu general public license as published by the free software foundation[,;]? either version 1,? or \(at your option\) any later version
gpl-3.0 :: 8 :: 0.96 :: gnu general public license :: under the terms of (?:the )?gnu general public license,? version 3(?:\.0)? only
gpl-2.0 :: 8 :: 0.96 :: gnu general public license :: under the terms of (?:the )?gnu general public license,? version 2(?:\.0)? only
gpl-2.0 :: 8 :: 0.96 :: gnu general public license version 2 as published :: gnu general public license version 2 as published by the free software foundation
gpl-3.0 :: 8 :: 0.96 :: gnu general public license version 3 as published :: gnu general public license version 3 as published by the free software foundation
lgpl-3.0 :: 8 :: 0.97 :: gnu lesser general public license as published :: gnu lesser general public license as published by the free software foundation[,;]? either version 3(?:\.0)? of the license
lgpl-2.1 :: 8 :: 0.97 :: gnu lesser general public license as published :: gnu lesser general public license as published by the free software foundation[,;]? either version 2\.1 of the license
lgpl-2.0 :: 8 :: 0.97 :: gnu library general public license as published :: gnu library general public license as published by the free software foundation[,;]? either version 2 of the license
agpl-3.0 :: 8 :: 0.97 :: gnu affero general public license as published :: gnu affero general public license as published by the free software foundation[,;]? either version 3 of the license
gpl :: 7 :: 0.9 :: received a copy of the gnu general public license :: you should have received a copy of the gnu general public license along with this
lgpl :: 7 :: 0.9 :: received a copy of the gnu lesser general public license :: you should have received a copy of the gnu lesser general public license along with this
agpl :: 7 :: 0.9 :: received a copy of the gnu affero general public license :: you should have received a copy of the gnu affero general public license along with this
gpl :: 7 :: 0.9 :: take away your freedom to share and change :: licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change (?:it|the works)
gpl-3.0 :: 7 :: 0.93 :: gnu general public license is a free, copyleft license :: the gnu general public license is a free, copyleft license for software and other kinds of works
gpl-3.0 :: 7 :: 0.9 :: installation information :: conveying under this section must be accompanied by the installation information
agpl-3.0 :: 7 :: 0.93 :: specifically designed to ensure cooperation with the community :: specifically designed to ensure cooperation with the community in the case of network server software
agpl-3.0 :: 7 :: 0.9 :: interacting with it remotely through a computer network :: offer all users interacting with it remotely through a computer network
lgpl-2.1 :: 7 :: 0.93 :: first released version of the lesser gpl :: this is the first released version of the lesser gpl
lgpl-3.0 :: 7 :: 0.93 :: incorporates the terms and conditions of version 3 :: this version of the gnu lesser general public license incorporates the terms and conditions of version 3
gfdl :: 7 :: 0.93 :: invariant sections :: with (?:no|the) invariant sections(?: being [^.]{1,200}?)?, (?:no|with (?:no|the)) front-cover texts
gfdl :: 8 :: 0.96 :: gnu free documentation license :: copy, distribute and/or modify this document under the terms of the gnu free documentation license
apache-2.0 :: 8 :: 0.98 :: apache license, version 2.0 :: licensed under the apache license, version 2\.0 \(the "license"\)
apache-2.0 :: 8 :: 0.95 :: except in compliance with the license :: you may not use this (?:file|work|software) except in compliance with the license
apache-2.0 :: 7 :: 0.93 :: perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable :: grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent) license
apache-2.0 :: 7 :: 0.92 :: distributed on an "as is" basis :: (?:software )?distributed under the license is distributed on an "as is" basis,? without warranties or conditions of any kind
apache-2.0 :: 7 :: 0.95 :: www.apache.org/licenses/license-2.0 :: https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
apache-1.1 :: 7 :: 0.93 :: apache software foundation :: this product includes software developed by the apache software foundation \(https?://www\.apache\.org/\)
apache-1.0 :: 7 :: 0.93 :: developed by the apache group :: this product includes software developed by the apache group for use in the apache http server project
mit :: 8 :: 0.97 :: permission is hereby granted, free of charge :: permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit :: 7 :: 0.9 :: permission is hereby granted, free of charge :: permission is hereby granted, free of charge, to any person obtaining a copy
mit :: 7 :: 0.92 :: permission notice shall be included in all copies :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit :: 7 :: 0.85 :: without warranty of any kind, express or implied :: the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
bsd :: 7 :: 0.9 :: redistribution and use in source and binary forms :: redistribution and use in source and binary forms, with or without modification, are permitted
bsd-2-clause :: 7 :: 0.9 :: redistributions in binary form must reproduce :: redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
bsd-3-clause :: 7 :: 0.93 :: may be used to endorse or promote products :: neither the name of [^.]{1,200}? may be used to endorse or promote products derived from this software
bsd-3-clause :: 7 :: 0.9 :: may not be used to endorse or promote products :: the names? of [^.]{1,200}? may not be used to endorse or promote products derived from this software
bsd-4-clause :: 7 :: 0.95 :: all advertising materials mentioning features :: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd :: 7 :: 0.85 :: this software is provided by :: this software is provided by [^.]{1,120}? "?as is"? and any express or implied warranties
isc :: 7 :: 0.93 :: permission to use, copy, modify :: permission to use, copy, modify,?(?: and/or| and) distribute this software for any purpose with or without fee is hereby granted
isc :: 7 :: 0.88 :: the author disclaims all warranties :: the software is provided "as is" and the author disclaims all warranties with regard to this software
mit-0 :: 7 :: 0.8 :: permission to use, copy, modify :: permission to use, copy, modify, and(?:/or)? distribute this software for any purpose is hereby granted without attribution
zlib :: 7 :: 0.93 :: provided 'as-is', without any express or implied warranty :: this software is provided 'as-is', without any express or implied warranty
zlib :: 7 :: 0.92 :: the origin of this software must not be misrepresented :: the origin of this software must not be misrepresented;? you must not claim that you wrote the original software
zlib :: 7 :: 0.9 :: altered source versions must be plainly marked :: altered source versions must be plainly marked as such,? and must not be misrepresented
mpl-2.0 :: 8 :: 0.98 :: mozilla public license, v. 2.0 :: this source code form is subject to the terms of the mozilla public license, v\. 2\.0
mpl-2.0 :: 7 :: 0.95 :: mozilla.org/mpl/2.0 :: https?://(?:www\.)?mozilla\.org/mpl/2\.0/?
mpl-1.1 :: 8 :: 0.97 :: mozilla public license version 1.1 :: the contents of this file are subject to the mozilla public license version 1\.1
mpl-1.0 :: 8 :: 0.97 :: mozilla public license version 1.0 :: the contents of this file are subject to the mozilla public license version 1\.0
mpl-2.0 :: 7 :: 0.85 :: incompatible with secondary licenses :: incompatible with secondary licenses, as defined by the mozilla public license
epl-2.0 :: 8 :: 0.97 :: eclipse public license 2.0 :: made available under the terms of the eclipse public license 2\.0
epl-1.0 :: 8 :: 0.97 :: eclipse public license v1.0 :: made available under the terms of the eclipse public license v1\.0
epl-2.0 :: 7 :: 0.95 :: eclipse.org/legal/epl-2.0 :: https?://www\.eclipse\.org/legal/epl-2\.0/?
epl-1.0 :: 7 :: 0.95 :: eclipse.org/legal/epl-v10 :: https?://www\.eclipse\.org/legal/epl-v10(?:\.html)?
cddl-1.0 :: 8 :: 0.95 :: common development and distribution license :: subject to the terms of the common development and distribution license
cpl-1.0 :: 7 :: 0.93 :: accompanying program is provided under the terms of this common public license :: the accompanying program is provided under the terms of this common public license
ibm-pl-1.0 :: 7 :: 0.93 :: ibm public license :: (?:provided under the terms of (?:this|the) )ibm public license
eupl-1.2 :: 8 :: 0.95 :: licensed under the eupl :: licensed under the eupl,? (?:version 1\.2|v\.? ?1\.2)
artistic-1.0 :: 7 :: 0.9 :: the intent of this document is to state the conditions :: the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 :: 7 :: 0.93 :: everyone is permitted to copy and distribute verbatim copies of this license document :: everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed
bsl-1.0 :: 8 :: 0.97 :: boost software license, version 1.0 :: distributed under the boost software license, version 1\.0
bsl-1.0 :: 7 :: 0.95 :: boost.org/license_1_0.txt :: https?://www\.boost\.org/license_1_0\.txt
bsl-1.0 :: 7 :: 0.9 :: machine-executable object code generated by a source language processor :: solely in the form of machine-executable object code generated by a source language processor
busl-1.1 :: 7 :: 0.93 :: business source license :: business source license(?: 1\.1)? (?:parameters|terms)
unlicense :: 8 :: 0.97 :: free and unencumbered software released into the public domain :: this is free and unencumbered software released into the public domain
unlicense :: 7 :: 0.93 :: unlicense.org :: https?://unlicense\.org/?
wtfpl :: 7 :: 0.95 :: you just do what the fuck you want to :: you just do what the fuck you want to
cc0-1.0 :: 8 :: 0.95 :: waived all copyright and related or neighboring rights :: (?:has )?waived all copyright and related or neighboring rights
cc0-1.0 :: 7 :: 0.95 :: creativecommons.org/publicdomain/zero :: https?://creativecommons\.org/publicdomain/zero/1\.0/?
public-domain :: 7 :: 0.95 :: creativecommons.org/publicdomain/mark :: https?://creativecommons\.org/publicdomain/mark/1\.0/?
cc-by-4.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by/4.0 :: https?://creativecommons\.org/licenses/by/4\.0/?
cc-by-3.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by/3.0 :: https?://creativecommons\.org/licenses/by/3\.0/?
cc-by-2.5 :: 7 :: 0.95 :: creativecommons.org/licenses/by/2.5 :: https?://creativecommons\.org/licenses/by/2\.5/?
cc-by-2.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by/2.0 :: https?://creativecommons\.org/licenses/by/2\.0/?
cc-by-sa-4.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by-sa/4.0 :: https?://creativecommons\.org/licenses/by-sa/4\.0/?
cc-by-sa-3.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by-sa/3.0 :: https?://creativecommons\.org/licenses/by-sa/3\.0/?
cc-by-nc-4.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by-nc/4.0 :: https?://creativecommons\.org/licenses/by-nc/4\.0/?
cc-by-nc-3.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by-nc/3.0 :: https?://creativecommons\.org/licenses/by-nc/3\.0/?
cc-by-nd-4.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by-nd/4.0 :: https?://creativecommons\.org/licenses/by-nd/4\.0/?
cc-by-nc-sa-4.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by-nc-sa/4.0 :: https?://creativecommons\.org/licenses/by-nc-sa/4\.0/?
cc-by-nc-sa-3.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by-nc-sa/3.0 :: https?://creativecommons\.org/licenses/by-nc-sa/3\.0/?
cc-by-nc-nd-4.0 :: 7 :: 0.95 :: creativecommons.org/licenses/by-nc-nd/4.0 :: https?://creativecommons\.org/licenses/by-nc-nd/4\.0/?
ofl-1.1 :: 8 :: 0.97 :: licensed under the sil open font license :: this font software is licensed under the sil open font license,? version 1\.1
ofl-1.1 :: 7 :: 0.93 :: reserved font name :: with reserved font names? [^.]{1,120}?\.
psf-2.0 :: 7 :: 0.93 :: psf license agreement for python :: psf license agreement for python(?: [23](?:\.\d+){0,2})?
postgresql :: 7 :: 0.9 :: without a written agreement is hereby granted :: without fee,? and without a written agreement is hereby granted
openssl :: 7 :: 0.93 :: openssl project for use in the openssl toolkit :: developed by the openssl project for use in the openssl toolkit
php-3.01 :: 7 :: 0.93 :: includes php software :: this product includes php software, freely available from
ms-pl :: 7 :: 0.9 :: contributor grants you a non-exclusive, worldwide, royalty-free copyright license :: each contributor grants you a non-exclusive, worldwide, royalty-free copyright license
ncsa :: 7 :: 0.9 :: deal with the software without restriction :: to deal with the software without restriction, including without limitation the rights to use, copy, modify
odbl-1.0 :: 8 :: 0.95 :: made available under the open database license :: made available under the open database license
pddl-1.0 :: 8 :: 0.95 :: made available under the public domain dedication and license :: made available under the public domain dedication and license
hpnd :: 7 :: 0.85 :: copyright notice appear in all copies and that both that copyright notice and this permission notice :: that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
curl :: 7 :: 0.8 :: used in advertising or otherwise to promote the sale :: shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software
json :: 7 :: 0.95 :: used for good, not evil :: the software shall be used for good, not evil
beerware :: 7 :: 0.95 :: buy me a beer :: you can buy me a beer in return
apache-2.0 :: 5 :: 0.95 :: apache license :: (?:dual-)?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?apache license,? ?(?:\(?version |v\.? ?)?2(?:\.0)?
apache-2.0 :: 5 :: 0.9 :: apache license :: (?:released|distributed|available|published|provided|shared) under (?:the |an? )?(?:terms of (?:the )?)?apache license,? ?(?:version |v\.? ?)?2(?:\.0)?
apache :: 5 :: 0.85 :: apache :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:the |an? )?(?:terms of (?:the )?)?apache (?:software )?license(?!,? ?(?:version |v\.? ?)?[12])
gpl-3.0 :: 5 :: 0.95 :: gnu g :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:the |a )?(?:terms of (?:the )?)?gnu (?:general public license|gpl),? ?(?:version |v\.? ?)?3(?:\.0)?
gpl-2.0 :: 5 :: 0.95 :: gnu g :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:the |a )?(?:terms of (?:the )?)?gnu (?:general public license|gpl),? ?(?:version |v\.? ?)?2(?:\.0)?
gpl :: 5 :: 0.85 :: gnu g :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:the |a )?(?:terms of (?:the )?)?gnu (?:general public license|gpl)(?!,? ?(?:version |v\.? ?)?[123])
gpl :: 5 :: 0.85 :: gpl :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:the |a )?gpl(?:v?[123])?
lgpl :: 5 :: 0.88 :: gnu lesser general public license :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public license
agpl-3.0 :: 5 :: 0.93 :: gnu affero general public license :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?gnu affero general public license,? ?(?:version |v\.? ?)?3(?:\.0)?
mit :: 5 :: 0.95 :: mit :: (?:dual-)?(?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:the |an? )?(?:terms of (?:the )?)?mit(?: license|/x11 license|-style license)?
bsd :: 5 :: 0.88 :: bsd license :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?bsd license
bsd-3-clause :: 5 :: 0.93 :: bsd :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?(?:3-clause|three-clause|new|modified|revised) bsd(?: license)?
bsd-2-clause :: 5 :: 0.93 :: bsd :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?(?:2-clause|two-clause|simplified) bsd(?: license)?
isc :: 5 :: 0.93 :: isc license :: (?:licen[cs]ed|released|distributed|available) under (?:the |an? )?isc license
mpl-2.0 :: 5 :: 0.95 :: mozilla public license :: (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mozilla public license,? ?(?:version |v\.? ?)?2(?:\.0)?
epl :: 5 :: 0.9 :: eclipse public license :: (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?eclipse public license
unlicense :: 5 :: 0.93 :: unlicense :: (?:licen[cs]ed|released|distributed|available) under (?:the )?unlicense
zlib :: 5 :: 0.93 :: zlib :: (?:licen[cs]ed|released|distributed|available) under (?:the )?zlib(?:/libpng)? license
cc0-1.0 :: 5 :: 0.95 :: cc0 :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:a |the )?(?:creative commons )?cc0
cc-by-4.0 :: 5 :: 0.95 :: cc :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:a |the )?(?:creative commons )?cc[ -]by[ -](?:version |v)?4\.0
cc-by-3.0 :: 5 :: 0.95 :: cc :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:a |the )?(?:creative commons )?cc[ -]by[ -](?:version |v)?3\.0
cc-by-sa-4.0 :: 5 :: 0.95 :: cc :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:a |the )?(?:creative commons )?cc[ -]by-sa[ -](?:version |v)?4\.0
cc-by-sa-3.0 :: 5 :: 0.95 :: cc :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:a |the )?(?:creative commons )?cc[ -]by-sa[ -](?:version |v)?3\.0
cc-by-nc :: 5 :: 0.93 :: cc :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:a |the )?(?:creative commons )?cc[ -]by-nc(?![ -]?(?:sa|nd))
cc-by-nc-sa :: 5 :: 0.93 :: cc :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:a |the )?(?:creative commons )?cc[ -]by-nc-sa
cc-by-nc-nd :: 5 :: 0.93 :: cc :: (?:licen[cs]ed|released|distributed|available|published|provided|shared) under (?:a |the )?(?:creative commons )?cc[ -]by-nc-nd
cc-by-4.0 :: 4 :: 0.93 :: creative commons attribution :: creative commons attribution 4\.0(?: international)?(?: (?:public )?license)?
cc-by-3.0 :: 4 :: 0.93 :: creative commons attribution :: creative commons attribution 3\.0(?: unported)?(?: license)?
cc-by-sa-4.0 :: 4 :: 0.93 :: creative commons attribution :: creative commons attribution[ -]share-?alike 4\.0(?: international)?(?: (?:public )?license)?
cc-by-sa-3.0 :: 4 :: 0.93 :: creative commons attribution :: creative commons attribution[ -]share-?alike 3\.0(?: unported)?(?: license)?
cc-by-nc-4.0 :: 4 :: 0.93 :: creative commons attribution :: creative commons attribution[ -]non-?commercial 4\.0(?: international)?(?: (?:public )?license)?
cc-by-nd-4.0 :: 4 :: 0.93 :: creative commons attribution :: creative commons attribution[ -]no-?deriv(?:ative)?s? 4\.0(?: international)?(?: (?:public )?license)?
cc-by-nc-sa-4.0 :: 4 :: 0.93 :: creative commons attribution :: creative commons attribution[ -]non-?commercial[ -]share-?alike 4\.0(?: international)?(?: (?:public )?license)?
cc-by-nc-nd-4.0 :: 4 :: 0.93 :: creative commons attribution :: creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s? 4\.0(?: international)?(?: (?:public )?license)?
cc-by-sa :: 3 :: 0.85 :: creative commons attribution :: creative commons attribution[ -]share-?alike(?: license)?
cc-by-nc :: 3 :: 0.85 :: creative commons attribution :: creative commons attribution[ -]non-?commercial(?: license)?
cc-by-nd :: 3 :: 0.85 :: creative commons attribution :: creative commons attribution[ -]no-?deriv(?:ative)?s?(?: license)?
cc-by :: 3 :: 0.8 :: creative commons attribution :: creative commons attribution(?: license)?
cc0-1.0 :: 3 :: 0.9 :: creative commons zero :: creative commons zero(?: v?1\.0)?(?: universal)?
cc-by-4.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]v?4\.0
cc-by-3.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]v?3\.0
cc-by-2.5 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]v?2\.5
cc-by-2.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]v?2\.0
cc-by-sa-4.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]sa[ -]v?4\.0
cc-by-sa-3.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]sa[ -]v?3\.0
cc-by-sa-2.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]sa[ -]v?2\.0
cc-by-nc-4.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]nc[ -]v?4\.0
cc-by-nc-3.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]nc[ -]v?3\.0
cc-by-nd-4.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]nd[ -]v?4\.0
cc-by-nd-3.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]nd[ -]v?3\.0
cc-by-nc-sa-4.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]nc[ -]sa[ -]v?4\.0
cc-by-nc-sa-3.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]nc[ -]sa[ -]v?3\.0
cc-by-nc-nd-4.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]nc[ -]nd[ -]v?4\.0
cc-by-nc-nd-3.0 :: 3 :: 0.85 :: cc :: cc[ -]by[ -]nc[ -]nd[ -]v?3\.0
cc-by-nc-sa :: 2 :: 0.75 :: cc :: cc[ -]by[ -]nc[ -]sa
cc-by-nc-nd :: 2 :: 0.75 :: cc :: cc[ -]by[ -]nc[ -]nd
cc-by-sa :: 2 :: 0.75 :: cc :: cc[ -]by[ -]sa
cc-by-nc :: 2 :: 0.75 :: cc :: cc[ -]by[ -]nc
cc-by-nd :: 2 :: 0.75 :: cc :: cc[ -]by[ -]nd
cc-by :: 2 :: 0.7 :: cc :: cc[ -]by
cc0-1.0 :: 2 :: 0.8 :: cc0 :: cc0(?:[ -](?:v?1\.0|universal))*
gpl-3.0 :: 3 :: 0.85 :: gnu general public license :: gnu general public license,? ?(?:\(gpl\),? )?(?:version |v\.? ?)?3(?:\.0)?
gpl-2.0 :: 3 :: 0.85 :: gnu general public license :: gnu general public license,? ?(?:\(gpl\),? )?(?:version |v\.? ?)?2(?:\.0)?
gpl-1.0 :: 3 :: 0.85 :: gnu general public license :: gnu general public license,? ?(?:\(gpl\),? )?(?:version |v\.? ?)?1(?:\.0)?
gpl :: 2 :: 0.75 :: gnu general public license :: gnu general public license
gpl-3.0 :: 3 :: 0.85 :: gpl :: (?:gnu )?gpl[ -]?(?:version |v\.? ?)?3(?:\.0)?
gpl-2.0 :: 3 :: 0.85 :: gpl :: (?:gnu )?gpl[ -]?(?:version |v\.? ?)?2(?:\.0)?
gpl :: 2 :: 0.7 :: gnu gpl :: gnu gpl
lgpl-3.0 :: 3 :: 0.85 :: general public license :: gnu (?:lesser|library) general public license,? ?(?:version |v\.? ?)?3(?:\.0)?
lgpl-2.1 :: 3 :: 0.85 :: general public license :: gnu (?:lesser|library) general public license,? ?(?:version |v\.? ?)?2\.1
lgpl-2.0 :: 3 :: 0.85 :: general public license :: gnu (?:lesser|library) general public license,? ?(?:version |v\.? ?)?2(?:\.0)?(?!\.1)
lgpl :: 2 :: 0.75 :: general public license :: gnu (?:lesser|library) general public license
lgpl-3.0 :: 3 :: 0.85 :: lgpl :: lgpl[ -]?(?:version |v\.? ?)?3(?:\.0)?
lgpl-2.1 :: 3 :: 0.85 :: lgpl :: lgpl[ -]?(?:version |v\.? ?)?2\.1
agpl-3.0 :: 3 :: 0.85 :: affero general public license :: (?:gnu )?affero general public license,? ?(?:version |v\.? ?)?3(?:\.0)?
agpl :: 2 :: 0.75 :: affero general public license :: (?:gnu )?affero general public license
agpl-3.0 :: 3 :: 0.85 :: agpl :: agpl[ -]?(?:version |v\.? ?)?3(?:\.0)?
gfdl-1.3 :: 3 :: 0.85 :: gnu free documentation license :: gnu free documentation license,? ?(?:version |v\.? ?)?1\.3
gfdl-1.2 :: 3 :: 0.85 :: gnu free documentation license :: gnu free documentation license,? ?(?:version |v\.? ?)?1\.2
gfdl :: 2 :: 0.75 :: gnu free documentation license :: gnu free documentation license
apache-2.0 :: 3 :: 0.85 :: apache :: apache (?:software )?license,? ?(?:version |v\.? ?)?2(?:\.0)?
apache-1.1 :: 3 :: 0.85 :: apache :: apache (?:software )?license,? ?(?:version |v\.? ?)?1\.1
apache-1.0 :: 3 :: 0.85 :: apache :: apache (?:software )?license,? ?(?:version |v\.? ?)?1\.0
apache :: 2 :: 0.7 :: apache :: apache (?:software )?license
mit-0 :: 3 :: 0.85 :: mit no attribution :: mit no attribution(?: license)?
mit :: 2 :: 0.7 :: license :: (?:mit|expat|x11|mit/x11) license
bsd-0-clause :: 3 :: 0.85 :: bsd license :: (?:0-clause|zero-clause) bsd license
bsd-2-clause :: 3 :: 0.85 :: bsd license :: (?:2-clause|two-clause|simplified|freebsd) bsd license
bsd-3-clause :: 3 :: 0.85 :: bsd license :: (?:3-clause|three-clause|new|modified|revised) bsd license
bsd-4-clause :: 3 :: 0.85 :: bsd license :: (?:4-clause|four-clause|original) bsd license
bsd-2-clause :: 3 :: 0.85 :: bsd :: bsd[ -](?:2|two)[ -]clause
bsd-3-clause :: 3 :: 0.85 :: bsd :: bsd[ -](?:3|three)[ -]clause
bsd :: 2 :: 0.7 :: bsd license :: bsd license
isc :: 2 :: 0.75 :: isc license :: isc license
mpl-2.0 :: 3 :: 0.85 :: mozilla public license :: mozilla public license,? ?(?:version |v\.? ?)?2(?:\.0)?
mpl-1.1 :: 3 :: 0.85 :: mozilla public license :: mozilla public license,? ?(?:version |v\.? ?)?1\.1
mpl-1.0 :: 3 :: 0.85 :: mozilla public license :: mozilla public license,? ?(?:version |v\.? ?)?1\.0
mpl :: 2 :: 0.75 :: mozilla public license :: mozilla public license
epl-2.0 :: 3 :: 0.85 :: eclipse public license :: eclipse public license,?[ -]*(?:version |v\.? ?)?2(?:\.0)?
epl-1.0 :: 3 :: 0.85 :: eclipse public license :: eclipse public license,?[ -]*(?:version |v\.? ?)?1(?:\.0)?
epl :: 2 :: 0.75 :: eclipse public license :: eclipse public license
cddl-1.0 :: 3 :: 0.85 :: common development and distribution license :: common development and distribution license,? ?\(?(?:cddl\)?,? )?(?:version |v\.? ?)?1(?:\.[01])?
cddl :: 2 :: 0.75 :: common development and distribution license :: common development and distribution license
cpl-1.0 :: 2 :: 0.75 :: common public license :: common public license(?:,? ?(?:version |v\.? ?)?1(?:\.0)?)?
eupl-1.2 :: 3 :: 0.85 :: european union public :: european union public licen[cs]e,? ?(?:version |v\.? ?)?1\.2
eupl :: 2 :: 0.75 :: european union public :: european union public licen[cs]e
artistic-2.0 :: 3 :: 0.85 :: artistic license :: artistic license,? ?(?:version |v\.? ?)?2(?:\.0)?
artistic-1.0 :: 2 :: 0.75 :: artistic license :: artistic license(?:,? ?(?:version |v\.? ?)?1(?:\.0)?)?
bsl-1.0 :: 2 :: 0.75 :: boost software license :: boost software license(?:,? ?(?:version |v\.? ?)?1(?:\.0)?)?
busl-1.1 :: 2 :: 0.8 :: business source license :: business source license(?:,? ?(?:version |v\.? ?)?1\.1)?
zlib :: 2 :: 0.75 :: zlib :: zlib(?:/libpng)? license
unlicense :: 2 :: 0.8 :: unlicense :: unlicense
wtfpl :: 2 :: 0.9 :: do what the fuck you want to public license :: do what the fuck you want to public license
wtfpl :: 2 :: 0.85 :: wtfpl :: wtfpl
ofl-1.1 :: 2 :: 0.8 :: open font license :: (?:sil )?open font license(?:,? ?(?:version |v\.? ?)?1\.[01])?
psf-2.0 :: 2 :: 0.8 :: python software foundation license :: python software foundation license(?:,? ?(?:version |v\.? ?)?2)?
postgresql :: 2 :: 0.8 :: postgresql license :: postgresql license
ms-pl :: 2 :: 0.8 :: microsoft public license :: microsoft public license
ms-rl :: 2 :: 0.8 :: microsoft reciprocal license :: microsoft reciprocal license
odbl-1.0 :: 2 :: 0.8 :: database license :: open (?:data commons open )?database license(?:,? ?(?:version |v\.? ?)?1(?:\.0)?)?
odc-by-1.0 :: 2 :: 0.8 :: open data commons attribution license :: open data commons attribution license(?:,? ?(?:version |v\.? ?)?1(?:\.0)?)?
pddl-1.0 :: 2 :: 0.8 :: public domain dedication and license :: public domain dedication and license
openssl :: 2 :: 0.75 :: openssl license :: openssl license
php-3.01 :: 2 :: 0.75 :: php license :: php license(?:,? ?(?:version |v\.? ?)?3\.01)?
ncsa :: 2 :: 0.8 :: open source license :: university of illinois(?:/ncsa)? open source license
osl-3.0 :: 2 :: 0.75 :: open software license :: open software license(?:,? ?(?:version |v\.? ?)?3(?:\.0)?)?
afl-3.0 :: 2 :: 0.75 :: academic free license :: academic free license(?:,? ?(?:version |v\.? ?)?3(?:\.0)?)?
sspl-1.0 :: 2 :: 0.8 :: server side public license :: server side public license(?:,? ?(?:version |v\.? ?)?1(?:\.0)?)?
elastic-2.0 :: 2 :: 0.8 :: elastic license :: elastic license(?:,? ?(?:version |v\.? ?)?2(?:\.0)?)?
polyform :: 2 :: 0.8 :: polyform :: polyform (?:noncommercial|shield|strict|small business|internal use) license(?: 1\.0\.0)?
rail :: 2 :: 0.75 :: responsible ai license :: (?:open )?responsible ai license
ecl-2.0 :: 2 :: 0.8 :: educational community license :: educational community license(?:,? ?(?:version |v\.? ?)?2(?:\.0)?)?
cecill :: 2 :: 0.8 :: cecill :: cecill(?:-[bc]| v?2(?:\.[01])?)?
w3c :: 2 :: 0.75 :: w3c software notice and license :: w3c software notice and license
vim :: 2 :: 0.75 :: vim license :: vim license
ijg :: 2 :: 0.75 :: independent jpeg group :: independent jpeg group(?:'s)?
public-domain :: 4 :: 0.85 :: public domain :: (?:released|dedicated|placed|put|donated)(?: in| into| to)? the public domain
public-domain :: 2 :: 0.7 :: in the public domain :: (?:is|are) in the public domain
proprietary :: 1 :: 0.6 :: all rights reserved :: all rights reserved
proprietary :: 1 :: 0.6 :: unauthorized copying :: unauthorized copying of this (?:file|software|document|material)
proprietary :: 1 :: 0.6 :: confidential and proprietary :: confidential and proprietary
"""
