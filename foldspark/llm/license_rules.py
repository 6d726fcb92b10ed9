"""The ordered signature rules of the license scan: one per line, in falling priority.

A line is ``label ; pattern``.  Patterns are matched on lower-cased words that are joined by single
spaces (punctuation is gone: "GPL-2.0" is "gpl 2 0"), at word borders on both sides.  A heading ``[name confidence]``
gives the confidence of the rules under it.  Where a pattern names a group ``name``, that group is the place found.
"""

RULES_TEXT = r"""
[grant 0.98]
mit ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)? to deal in the software without restriction
mit ; to use copy modify merge publish distribute sublicense and or sell copies of the software
mit ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
x11 ; except as contained in this notice the name of the x consortium shall not be used in advertising
xfree86 ; except as contained in this notice the name of the xfree86 project inc shall not be used in advertising
bsd-4-clause ; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause ; neither the name of .{1,80}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause ; the name of the author may not be used to endorse or promote products derived from this software
bsd-2-clause ; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause ; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-0 ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc ; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
hpnd ; permission to use copy modify and distribute this software and its documentation for any purpose (and )?without fee is hereby granted
ntp ; permission to use copy modify and distribute this software .{0,60}without fee .{0,200}makes no representations about the suitability
zlib ; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib ; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib ; this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
libpng ; this copyright notice may not be removed or altered from any source or altered source distribution
boost-1 ; boost software license version 1 0 .{0,40}permission is hereby granted free of charge
boost-1 ; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
apache-2 ; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 ; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 ; see the license for the specific language governing permissions and limitations under the license
apache-1.1 ; this product includes software developed by the apache software foundation
gpl-2-or-later ; redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 (of the license )?or at your option any later version
gpl-3-or-later ; redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 (of the license )?or at your option any later version
gpl-2-only ; redistribute it and or modify it under the terms of (version 2 of the gnu general public license|the gnu general public license version 2) as published by the free software foundation
gpl-3-only ; redistribute it and or modify it under the terms of (version 3 of the gnu general public license|the gnu general public license version 3) as published by the free software foundation
gpl-1-or-later ; redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl ; you should have received a copy of the gnu general public license along with
lgpl-2.1-or-later ; redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 (of the license )?or at your option any later version
lgpl-3-or-later ; redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 (of the license )?or at your option any later version
lgpl-2-or-later ; redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 (of the license )?or at your option any later version
lgpl ; you should have received a copy of the gnu (lesser|library) general public license along with
agpl-3-or-later ; redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 (of the license )?or at your option any later version
agpl-3 ; you should have received a copy of the gnu affero general public license along with
gfdl ; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 ; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 ; the contents of this file are subject to the mozilla public license version 1 1
mpl-1 ; the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 ; the contents of this file are subject to the netscape public license version 1 1
cddl-1 ; the contents of this file are subject to the terms of the common development and distribution license
epl-1 ; this program and the accompanying materials are made available under the terms of the eclipse public license v(ersion)? ?1 0
epl-2 ; this program and the accompanying materials are made available under the terms of the eclipse public license (v ?)?2 0
cpl-1 ; this program and the accompanying materials are made available under the terms of the common public license v1 0
eupl-1.2 ; licensed under the eupl version 1 2 or as soon they will be approved by the european commission
eupl-1.1 ; licensed under the eupl version 1 1 or as soon they will be approved by the european commission
unlicense ; this is free and unencumbered software released into the public domain
unlicense ; anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
wtfpl ; everyone is permitted to copy and distribute verbatim or modified copies of this license document
wtfpl ; do what the fuck you want to
beerware ; if we meet some day and you think this stuff is worth it you can buy me a beer
cc0-1 ; waived all copyright and related or neighboring rights
cc-by ; you are free to share .{0,120}adapt .{0,200}you must give appropriate credit
openssl ; this product includes software developed by the openssl project for use in the openssl toolkit
ssleay ; this product includes cryptographic software written by eric young
php-3 ; this product includes php software freely available from
ruby ; you may make and give away verbatim copies of the source form of the software without restriction
artistic-1 ; the intent of this document is to state the conditions under which a package may be copied
artistic-2 ; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package
ofl-1.1 ; this font software is licensed under the sil open font license version 1 1
ofl-1.1 ; no modified version of the font software may use the reserved font name
bitstream-vera ; bitstream vera is a trademark of bitstream
unicode ; permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
icu ; icu license icu 1 8 1 and later
python-2 ; this license agreement is between the python software foundation
postgresql ; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa ; university of illinois ncsa open source license
sleepycat ; redistributions in any form must be accompanied by information on how to obtain complete source code
vim ; vim is charityware
afl-3 ; licensed under the academic free license version 3 0
osl-3 ; licensed under the open software license version 3 0
ms-pl ; this license governs use of the accompanying software if you use the software you accept this license
elastic-2 ; you may not provide the software to third parties as a hosted or managed service
sspl-1 ; if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
busl-1.1 ; effective on the change date .{0,120}the licensor hereby grants you rights under the terms of the change license
commons-clause ; without limiting other conditions in the license the grant of rights under the license will not include .{0,80}the right to sell the software
proprietary ; unauthorized copying (of this file )?via any medium is strictly prohibited
proprietary ; proprietary and confidential
[identifier 0.95]
mit ; spdx license identifier mit
mit-0 ; spdx license identifier mit 0
apache-2 ; spdx license identifier apache 2 0
bsd-2-clause ; spdx license identifier bsd 2 clause
bsd-3-clause ; spdx license identifier bsd 3 clause
bsd-4-clause ; spdx license identifier bsd 4 clause
bsd-0 ; spdx license identifier 0bsd
isc ; spdx license identifier isc
zlib ; spdx license identifier zlib
gpl-2-only ; spdx license identifier gpl 2 0( only)?
gpl-2-or-later ; spdx license identifier gpl 2 0 or later
gpl-3-only ; spdx license identifier gpl 3 0( only)?
gpl-3-or-later ; spdx license identifier gpl 3 0 or later
lgpl-2-only ; spdx license identifier lgpl 2 0( only)?
lgpl-2-or-later ; spdx license identifier lgpl 2 0 or later
lgpl-2.1-only ; spdx license identifier lgpl 2 1( only)?
lgpl-2.1-or-later ; spdx license identifier lgpl 2 1 or later
lgpl-3-only ; spdx license identifier lgpl 3 0( only)?
lgpl-3-or-later ; spdx license identifier lgpl 3 0 or later
agpl-3-only ; spdx license identifier agpl 3 0( only)?
agpl-3-or-later ; spdx license identifier agpl 3 0 or later
mpl-1.1 ; spdx license identifier mpl 1 1
mpl-2 ; spdx license identifier mpl 2 0
epl-1 ; spdx license identifier epl 1 0
epl-2 ; spdx license identifier epl 2 0
cddl-1 ; spdx license identifier cddl 1 0
cddl-1.1 ; spdx license identifier cddl 1 1
cc0-1 ; spdx license identifier cc0 1 0
cc-by-4 ; spdx license identifier cc by 4 0
cc-by-sa-4 ; spdx license identifier cc by sa 4 0
cc-by-nc-4 ; spdx license identifier cc by nc 4 0
cc-by-nd-4 ; spdx license identifier cc by nd 4 0
cc-by-nc-sa-4 ; spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4 ; spdx license identifier cc by nc nd 4 0
boost-1 ; spdx license identifier bsl 1 0
busl-1.1 ; spdx license identifier busl 1 1
unlicense ; spdx license identifier unlicense
wtfpl ; spdx license identifier wtfpl
artistic-2 ; spdx license identifier artistic 2 0
ofl-1.1 ; spdx license identifier ofl 1 1
python-2 ; spdx license identifier (psf|python) 2 0
postgresql ; spdx license identifier postgresql
eupl-1.2 ; spdx license identifier eupl 1 2
osl-3 ; spdx license identifier osl 3 0
afl-3 ; spdx license identifier afl 3 0
ms-pl ; spdx license identifier ms pl
blueoak-1 ; spdx license identifier blueoak 1 0 0
mulan-2 ; spdx license identifier mulanpsl 2 0
elastic-2 ; spdx license identifier elastic 2 0
sspl-1 ; spdx license identifier sspl 1 0
other-spdx ; spdx license identifier [^ ]+
[name 0.9]
gpl-3-or-later ; (gnu )?gpl (version |v )?3( 0)? or (at your option any )?later( version)?
gpl-3-or-later ; gplv3 or later
gpl-2-or-later ; (gnu )?gpl (version |v )?2( 0)? or (at your option any )?later( version)?
gpl-2-or-later ; gplv2 or later
apache-2 ; apache (software )?license v(ersion )?2( 0)?
apache-2 ; apache (software )?license 2( 0)?
apache-2 ; apache 2( 0)? licen[cs]ed?
apache-2 ; apache license version 2
apache-1.1 ; apache (software )?license (version |v ?)?1 1
apache-1 ; apache (software )?license (version |v ?)?1 0
gpl-3 ; gnu general public licen[cs]e (version |v ?)?3( 0)?
gpl-3 ; gnu gpl (version |v ?)?3( 0)?
gpl-3 ; (gnu )?gplv3
gpl-3 ; gpl (version |v )?3( 0)?
gpl-2 ; gnu general public licen[cs]e (version |v ?)?2( 0)?
gpl-2 ; gnu gpl (version |v ?)?2( 0)?
gpl-2 ; (gnu )?gplv2
gpl-2 ; gpl (version |v )?2( 0)?
gpl-1 ; gnu general public licen[cs]e (version |v ?)?1( 0)?
lgpl-3 ; gnu lesser general public licen[cs]e (version |v ?)?3( 0)?
lgpl-3 ; (gnu )?lgpl (version |v )?3( 0)?
lgpl-3 ; (gnu )?lgplv3
lgpl-2.1 ; gnu lesser general public licen[cs]e (version |v ?)?2 1
lgpl-2.1 ; (gnu )?lgpl (version |v )?2 1
lgpl-2.1 ; (gnu )?lgplv2 1
lgpl-2 ; gnu library general public licen[cs]e (version |v ?)?2( 0)?
lgpl-2 ; (gnu )?lgpl (version |v )?2 0
agpl-3 ; (gnu )?affero general public licen[cs]e (version |v ?)?3( 0)?
agpl-3 ; (gnu )?agpl (version |v )?3( 0)?
agpl-3 ; (gnu )?agplv3
agpl-1 ; affero general public licen[cs]e (version |v ?)?1( 0)?
gfdl-1.3 ; gnu free documentation licen[cs]e (version |v ?)?1 3
gfdl-1.2 ; gnu free documentation licen[cs]e (version |v ?)?1 2
gfdl-1.1 ; gnu free documentation licen[cs]e (version |v ?)?1 1
mpl-2 ; mozilla public licen[cs]e (version |v ?)?2( 0)?
mpl-2 ; mpl (version |v )?2( 0)?
mpl-1.1 ; mozilla public licen[cs]e (version |v ?)?1 1
mpl-1.1 ; mpl (version |v )?1 1
mpl-1 ; mozilla public licen[cs]e (version |v ?)?1 0
epl-2 ; eclipse public licen[cs]e (version |v ?)?2( 0)?
epl-2 ; epl (version |v )?2( 0)?
epl-1 ; eclipse public licen[cs]e (version |v ?)?1( 0)?
epl-1 ; epl (version |v )?1( 0)?
cddl-1.1 ; common development and distribution licen[cs]e (version |v ?)?1 1
cddl-1 ; common development and distribution licen[cs]e (version |v ?)?1 0
cddl-1 ; cddl (version |v )?1 0
cpl-1 ; common public licen[cs]e (version |v ?)?1( 0)?
eupl-1.2 ; european union public licen[cs]e (version |v ?)?1 2
eupl-1.1 ; european union public licen[cs]e (version |v ?)?1 1
cecill-2.1 ; cecill (free software licen[cs]e agreement )?(version |v )?2 1
cecill-b ; cecill b( licen[cs]e)?
cecill-c ; cecill c( licen[cs]e)?
boost-1 ; boost software licen[cs]e( (version |v ?)?1( 0)?)?
artistic-2 ; artistic licen[cs]e (version |v ?)?2( 0)?
artistic-1 ; artistic licen[cs]e (version |v ?)?1( 0)?
perl ; under the same terms as perl( itself)?
ofl-1.1 ; sil open font licen[cs]e( (version |v ?)?1 1)?
zpl-2.1 ; zope public licen[cs]e( (version |v ?)?2 1)?
python-2 ; python software foundation licen[cs]e( version 2)?
cnri-python ; cnri (open source )?licen[cs]e agreement
php-3 ; php licen[cs]e( (version |v ?)?3 01?)?
w3c ; w3c software (notice and )?licen[cs]e
ms-pl ; microsoft public licen[cs]e
ms-rl ; microsoft reciprocal licen[cs]e
upl-1 ; universal permissive licen[cs]e( (version |v ?)?1 0)?
ncsa ; ncsa (open source )?licen[cs]e
isc ; isc licen[cs]e
zlib ; zlib( libpng)? licen[cs]e
openssl ; openssl licen[cs]e
qpl-1 ; q public licen[cs]e( (version |v ?)?1 0)?
ibm-1 ; ibm public licen[cs]e( (version |v ?)?1 0)?
apsl-2 ; apple public source licen[cs]e( (version |v ?)?2 0)?
intel ; intel open source licen[cs]e
nasa-1.3 ; nasa open source agreement( (version |v ?)?1 3)?
afl-3 ; academic free licen[cs]e( (version |v ?)?3 0)?
osl-3 ; open software licen[cs]e( (version |v ?)?3 0)?
rpl-1.5 ; reciprocal public licen[cs]e( (version |v ?)?1 5)?
ecl-2 ; educational community licen[cs]e( (version |v ?)?2 0)?
mulan-2 ; mulan (psl|permissive software licen[cs]e)( v(ersion )?2)?
blueoak-1 ; blue oak model licen[cs]e( 1 0 0)?
elastic-2 ; elastic licen[cs]e( (version |v ?)?2( 0)?)?
sspl-1 ; server side public licen[cs]e( (version |v ?)?1)?
busl-1.1 ; business source licen[cs]e( (version |v ?)?1 1)?
commons-clause ; commons clause
odbl-1 ; open (data commons open )?database licen[cs]e( (version |v ?)?1 0)?
odc-by-1 ; open data commons attribution licen[cs]e
pddl-1 ; public domain dedication and licen[cs]e
cdla-permissive ; community data licen[cs]e agreement permissive
cdla-sharing ; community data licen[cs]e agreement sharing
ogl-uk-3 ; open government licen[cs]e( (version |v ?)?3 0)?
etalab-2 ; licence ouverte( 2 0)?
llama ; llama [0-9 ]*community licen[cs]e( agreement)?
openrail ; openrail( m| d| s)*
openrail ; open rail( m| d| s)*
gemma ; gemma terms of use
[creative 0.9]
cc-by-nc-nd-4 ; cc by nc nd (version |v )?4 0
cc-by-nc-nd-3 ; cc by nc nd (version |v )?3 0
cc-by-nc-sa-4 ; cc by nc sa (version |v )?4 0
cc-by-nc-sa-3 ; cc by nc sa (version |v )?3 0
cc-by-nc-4 ; cc by nc (version |v )?4 0
cc-by-nc-3 ; cc by nc (version |v )?3 0
cc-by-nd-4 ; cc by nd (version |v )?4 0
cc-by-nd-3 ; cc by nd (version |v )?3 0
cc-by-sa-4 ; cc by sa (version |v )?4 0
cc-by-sa-3 ; cc by sa (version |v )?3 0
cc-by-4 ; cc by (version |v )?4 0
cc-by-3 ; cc by (version |v )?3 0
cc-by-nc-nd ; cc by nc nd
cc-by-nc-sa ; cc by nc sa
cc-by-nc ; cc by nc
cc-by-nd ; cc by nd
cc-by-sa ; cc by sa
cc0-1 ; cc0( 1 0( universal)?)?
cc-by-nc-nd ; creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?( [1-4] 0)?( international| unported)?( licen[cs]e)?
cc-by-nc-sa ; creative commons attribution non ?commercial share ?alike( [1-4] 0)?( international| unported)?( licen[cs]e)?
cc-by-nc ; creative commons attribution non ?commercial( [1-4] 0)?( international| unported)?( licen[cs]e)?
cc-by-nd ; creative commons attribution no ?deriv(ative)?s?( [1-4] 0)?( international| unported)?( licen[cs]e)?
cc-by-sa ; creative commons attribution share ?alike( [1-4] 0)?( international| unported)?( licen[cs]e)?
cc-by ; creative commons attribution( [1-4] 0)?( international| unported)?( licen[cs]e)?
cc0-1 ; creative commons (zero|cc0)( 1 0)?( universal)?( public domain dedication)?
[address 0.85]
mit ; (www )?opensource org licenses mit( license)?( php)?
bsd-2-clause ; (www )?opensource org licenses bsd (license|2 clause)( php)?
bsd-3-clause ; (www )?opensource org licenses bsd 3 clause
apache-2 ; (www )?apache org licenses license 2 0( html| txt)?
apache-2 ; (www )?opensource org licenses apache (license )?2 0
gpl-2 ; (www )?gnu org licenses (old licenses )?gpl 2 0( html| txt)?
gpl-3 ; (www )?gnu org licenses gpl 3 0( html| txt)?
gpl ; (www )?gnu org (copyleft|licenses) gpl( html| txt)?
lgpl-2.1 ; (www )?gnu org licenses (old licenses )?lgpl 2 1( html| txt)?
lgpl-3 ; (www )?gnu org licenses lgpl 3 0( html| txt)?
lgpl ; (www )?gnu org (copyleft|licenses) (lesser|lgpl)( html| txt)?
agpl-3 ; (www )?gnu org licenses agpl( 3 0)?( html| txt)?
gfdl ; (www )?gnu org (copyleft|licenses) fdl( html| txt)?
mpl-2 ; (www )?mozilla org mpl 2 0
mpl-1.1 ; (www )?mozilla org mpl mpl 1 1
mpl ; (www )?mozilla org mpl
epl-1 ; (www )?eclipse org legal epl v10
epl-2 ; (www )?eclipse org legal epl (v20|2 0)
boost-1 ; (www )?boost org license 1 0
cc0-1 ; creativecommons org publicdomain zero 1 0
cc-by-nc-nd ; creativecommons org licenses by nc nd( [1-4] 0)?
cc-by-nc-sa ; creativecommons org licenses by nc sa( [1-4] 0)?
cc-by-nc ; creativecommons org licenses by nc( [1-4] 0)?
cc-by-nd ; creativecommons org licenses by nd( [1-4] 0)?
cc-by-sa ; creativecommons org licenses by sa( [1-4] 0)?
cc-by ; creativecommons org licenses by( [1-4] 0)?
unlicense ; (www )?unlicense org
ofl-1.1 ; scripts sil org ofl
wtfpl ; (www )?wtfpl net
[notice 0.75]
mit ; (released |licensed |distributed |available |published )?under (the )?(terms of the )?mit licen[cs]e
mit ; mit licensed
mit ; (mit )?expat licen[cs]e
mit ; under the terms of (the )?mit
apache-2 ; (released |licensed |distributed )under apache 2( 0)?
bsd-3-clause ; (3 clause|three clause|new|modified|revised) bsd( licen[cs]e)?
bsd-3-clause ; bsd 3 clause( licen[cs]e)?
bsd-2-clause ; (2 clause|two clause|simplified|freebsd) bsd( licen[cs]e)?
bsd-2-clause ; bsd 2 clause( licen[cs]e)?
bsd-4-clause ; (4 clause|four clause|original|old) bsd( licen[cs]e)?
bsd-3-clause ; (new|modified|revised) bsd licen[cs]e
bsd-2-clause ; (simplified|freebsd) bsd licen[cs]e
bsd ; bsd( style)? licen[cs]e
bsd ; (released |licensed |distributed )under (the )?bsd
gpl ; gnu general public licen[cs]e
gpl ; (released |licensed |distributed )under (the )?(gnu )?gpl
lgpl ; gnu lesser general public licen[cs]e
lgpl ; (released |licensed |distributed )under (the )?(gnu )?lgpl
agpl ; (gnu )?affero general public licen[cs]e
gfdl ; gnu free documentation licen[cs]e
mpl ; mozilla public licen[cs]e
epl ; eclipse public licen[cs]e
cddl ; cddl
apache ; apache (software )?licen[cs]e
artistic ; artistic licen[cs]e
cc ; creative commons( licen[cs]e)?
unlicense ; the unlicense
wtfpl ; wtfpl
public-domain ; (released |placed |dedicated |put )(in|into|to) the public domain
public-domain ; this (work|file|software|text|book|document) is (in )?(the )?public domain
public-domain ; the authors? (hereby )?disclaims? copyright
dual ; dual licensed under
proprietary ; all rights reserved
proprietary ; for evaluation (purposes )?only
proprietary ; for internal use only
proprietary ; (do not|may not be) (redistributed?|copied|reproduced) without (prior |written |prior written |our )*permission
non-commercial ; (for )?non ?commercial (use|purposes) only
non-commercial ; (for )?non commercial (use|purposes)( only)?
research-only ; (for )?(academic |non commercial )?research (use|purposes) only
[mention 0.5]
mit ; mit licen[cs]e
apache ; apache licen[cs]e
bsd ; bsd licen[cs]e
gpl ; gpl licen[cs]e
gpl ; (gnu )?gpl
lgpl ; (gnu )?lgpl
agpl ; (gnu )?agpl
isc ; isc license
freeware ; freeware
shareware ; shareware
other-licensed ; licensed under (?:the |a )?(?P<name>(?:[^ ]+ ){1,4}licen[cs]e)
"""
