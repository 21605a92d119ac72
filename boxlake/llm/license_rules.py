"""Signature rules of the license scan, written by hand.

One rule a line: label | keywords | regular expression. The expression is matched against the lower-case
words of a text joined by single spaces, from word to word; all keywords must be words of the text
before it is tried. The sections go from the most to the least telling: a detection inside the words of
one of an earlier section (or of a longer one of the same section) says nothing of its own.
"""

from __future__ import annotations

# section: (priority, weight)
SECTIONS = {
    "identifier": (1, 1.0),
    "grant": (2, 0.95),
    "wording": (3, 0.9),
    "title": (4, 0.8),
    "address": (5, 0.7),
    "mention": (6, 0.5),
}

IDENTIFIER = r"""
gpl-1.0 | spdx | spdx license identifier a?gpl 1 0( only| or later)?
gpl-2.0-only | spdx gpl | spdx license identifier gpl 2 0( only)?
gpl-2.0-or-later | spdx gpl later | spdx license identifier gpl 2 0 or later
gpl-3.0-only | spdx gpl | spdx license identifier gpl 3 0( only)?
gpl-3.0-or-later | spdx gpl later | spdx license identifier gpl 3 0 or later
lgpl-2.0 | spdx lgpl | spdx license identifier lgpl 2 0( only| or later)?
lgpl-2.1 | spdx lgpl | spdx license identifier lgpl 2 1( only| or later)?
lgpl-3.0 | spdx lgpl | spdx license identifier lgpl 3 0( only| or later)?
agpl-3.0 | spdx agpl | spdx license identifier agpl 3 0( only| or later)?
gfdl-1.3 | spdx gfdl | spdx license identifier gfdl 1 [123]( only| or later)?
apache-1.1 | spdx apache | spdx license identifier apache 1 [01]
apache-2.0 | spdx apache | spdx license identifier apache 2 0( with llvm exception)?
mit | spdx mit | spdx license identifier mit
mit-0 | spdx mit | spdx license identifier mit 0
x11 | spdx x11 | spdx license identifier x11
isc | spdx isc | spdx license identifier isc
0bsd | spdx 0bsd | spdx license identifier 0bsd
bsd-2-clause | spdx bsd clause | spdx license identifier bsd 2 clause( patent)?
bsd-3-clause | spdx bsd clause | spdx license identifier bsd 3 clause( clear)?
bsd-4-clause | spdx bsd clause | spdx license identifier bsd 4 clause
mpl-1.1 | spdx mpl | spdx license identifier mpl 1 [01]
mpl-2.0 | spdx mpl | spdx license identifier mpl 2 0( no copyleft exception)?
epl-1.0 | spdx epl | spdx license identifier epl 1 0
epl-2.0 | spdx epl | spdx license identifier epl 2 0
cddl-1.0 | spdx cddl | spdx license identifier cddl 1 [01]
eupl-1.2 | spdx eupl | spdx license identifier eupl 1 [012]
cecill-2.1 | spdx cecill | spdx license identifier cecill( [bc]| 2 [01])?
artistic-2.0 | spdx artistic | spdx license identifier artistic 2 0
ms-pl | spdx ms pl | spdx license identifier ms pl
ms-rl | spdx ms rl | spdx license identifier ms rl
bsl-1.0 | spdx bsl | spdx license identifier bsl 1 0
busl-1.1 | spdx busl | spdx license identifier busl 1 1
sspl-1.0 | spdx sspl | spdx license identifier sspl 1 0
zlib | spdx zlib | spdx license identifier zlib
unlicense | spdx unlicense | spdx license identifier unlicense
wtfpl | spdx wtfpl | spdx license identifier wtfpl
cc0-1.0 | spdx cc0 | spdx license identifier cc0 1 0
cc-by-4.0 | spdx cc by | spdx license identifier cc by 4 0
cc-by-3.0 | spdx cc by | spdx license identifier cc by 3 0
cc-by-sa-4.0 | spdx cc sa | spdx license identifier cc by sa 4 0
cc-by-sa-3.0 | spdx cc sa | spdx license identifier cc by sa 3 0
cc-by-nc-4.0 | spdx cc nc | spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 | spdx cc nc sa | spdx license identifier cc by nc sa 4 0
cc-by-nd-4.0 | spdx cc nd | spdx license identifier cc by nd 4 0
cc-by-nc-nd-4.0 | spdx cc nc nd | spdx license identifier cc by nc nd 4 0
odbl-1.0 | spdx odbl | spdx license identifier odbl 1 0
odc-by-1.0 | spdx odc | spdx license identifier odc by 1 0
pddl-1.0 | spdx pddl | spdx license identifier pddl 1 0
ofl-1.1 | spdx ofl | spdx license identifier ofl 1 [01]
python-2.0 | spdx | spdx license identifier (python|psf) 2 0
postgresql | spdx postgresql | spdx license identifier postgresql
openssl | spdx openssl | spdx license identifier openssl
upl-1.0 | spdx upl | spdx license identifier upl 1 0
ncsa | spdx ncsa | spdx license identifier ncsa
"""

GRANT = r"""
gpl-1.0-or-later | gnu general version 1 later | gnu general public licen[cs]e( as published by the free software foundation)? (either )?version 1( of the licen[cs]e)? or (at your option )?any later version
gpl-2.0-or-later | gnu general version 2 later | gnu general public licen[cs]e( as published by the free software foundation)? (either )?version 2( of the licen[cs]e)? or (at your option )?any later version
gpl-3.0-or-later | gnu general version 3 later | gnu general public licen[cs]e( as published by the free software foundation)? (either )?version 3( of the licen[cs]e)? or (at your option )?any later version
gpl-2.0-only | gnu general version 2 only | gnu general public licen[cs]e version 2 only
gpl-3.0-only | gnu general version 3 only | gnu general public licen[cs]e version 3 only
gpl-3.0 | gnu general 3 | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?gnu general public licen[cs]e (version |v )?3( 0)?
gpl-2.0 | gnu general 2 | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?gnu general public licen[cs]e (version |v )?2( 0)?
gpl-3.0 | under gplv3 | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?gplv3
gpl-2.0 | under gplv2 | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?gplv2
lgpl-2.1-or-later | gnu lesser 2 1 later | gnu lesser general public licen[cs]e( as published by the free software foundation)? (either )?version 2 1( of the licen[cs]e)? or (at your option )?any later version
lgpl-3.0-or-later | gnu lesser 3 later | gnu lesser general public licen[cs]e( as published by the free software foundation)? (either )?version 3( of the licen[cs]e)? or (at your option )?any later version
lgpl-2.0-or-later | gnu library general 2 later | gnu library general public licen[cs]e( as published by the free software foundation)? (either )?version 2( of the licen[cs]e)? or (at your option )?any later version
agpl-3.0-or-later | gnu affero 3 later | gnu affero general public licen[cs]e( as published by the free software foundation)? (either )?version 3( of the licen[cs]e)? or (at your option )?any later version
agpl-3.0 | under affero | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?(gnu )?affero general public licen[cs]e( version 3| v3)?
apache-2.0 | apache 2 0 under | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?apache licen[cs]e (version )?2 0( the license)?
apache-2.0 | file except compliance | you may not use this file except in compliance with the license
apache-1.1 | apache 1 1 under | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?apache (software )?licen[cs]e (version )?1 1
mit | mit under | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?mit licen[cs]e
mit | mit licensed | this (software|project|work|code|library) is mit licensed
bsd-2-clause | bsd 2 clause under | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?(simplified )?bsd 2 clause licen[cs]e
bsd-3-clause | bsd 3 clause under | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?(new |modified |revised )?bsd 3 clause licen[cs]e
bsd | bsd under | (licensed|distributed|released|published|available) under (the )?(terms of )?(the |a )?bsd( style)? licen[cs]e
isc | isc under | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?isc licen[cs]e
mpl-2.0 | mozilla subject source form | this source code form is subject to the terms of the mozilla public licen[cs]e v(ersion)? ?2 0
mpl-2.0 | mozilla under 2 0 | (licensed|distributed|released|published|available) under (the )?(terms of )?(the )?mozilla public licen[cs]e (version |v )?2 0
mpl-1.1 | mozilla subject 1 1 | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
epl-1.0 | eclipse 0 accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(ersion)? ?1 0
epl-2.0 | eclipse 0 accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (v(ersion)? ?)?2 0
cddl-1.0 | common development distribution subject | subject to the terms of the common development and distribution licen[cs]e
eupl-1.2 | eupl under | licensed under the eupl( version)?( 1 [12])?
eupl-1.2 | european union public under | licensed under the european union public licen[cs]e( version)?( v)?( 1 [12])?
artistic-2.0 | artistic 2 0 under | under (the )?(terms of )?(the )?artistic licen[cs]e (version )?2 0
perl | same terms perl itself | under the same terms as (the )?perl( 5)?( programming language system)? itself
python-2.0 | python software foundation under | under (the )?(terms of )?(the )?python software foundation licen[cs]e
zlib | zlib under | (licensed|distributed|released|available) under (the )?(terms of )?(the )?zlib( libpng)? licen[cs]e
bsl-1.0 | boost software under | (licensed|distributed|released) under (the )?boost software licen[cs]e( version)?( 1 0)?
wtfpl | wtfpl under | (licensed|distributed|released|published) under (the )?(terms of )?(the )?wtfpl
unlicense | unlicense under | (licensed|distributed|released|dedicated) under (the )?unlicense
ms-pl | microsoft public under | under (the )?(terms of )?(the )?microsoft public licen[cs]e
ms-rl | microsoft reciprocal under | under (the )?(terms of )?(the )?microsoft reciprocal licen[cs]e
cc0-1.0 | waived extent copyright | to the extent possible under law .{0,80}? has waived all copyright
cc0-1.0 | cc0 under | (licensed|released|published|available|dedicated) under (the )?(creative commons )?cc0( 1 0)?( universal)?
cc-by-nc-nd-4.0 | cc nc nd under | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by nc nd( 4 0)?
cc-by-nc-sa-4.0 | cc nc sa under | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by nc sa( 4 0)?
cc-by-nc-4.0 | cc nc under 4 0 | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by nc 4 0
cc-by-nc | cc nc under | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by nc( [123] [05])?
cc-by-nd-4.0 | cc nd under | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by nd( 4 0)?
cc-by-sa-4.0 | cc sa under 4 0 | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by sa 4 0
cc-by-sa-3.0 | cc sa under 3 0 | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by sa 3 0
cc-by-4.0 | cc by under 4 0 | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by 4 0
cc-by-3.0 | cc by under 3 0 | (licensed|released|published|available|shared) under (a |the )?(creative commons )?cc by 3 0
cc-by-4.0 | creative commons attribution 4 0 under | under (a |the )?creative commons attribution 4 0( international)?( public)?( licen[cs]e)?
cc-by-3.0 | creative commons attribution 3 0 under | under (a |the )?creative commons attribution 3 0( unported)?( licen[cs]e)?
cc-by-sa-4.0 | creative commons attribution 4 0 under | under (a |the )?creative commons attribution share ?alike 4 0( international)?( licen[cs]e)?
cc-by-sa-3.0 | creative commons attribution 3 0 under | under (a |the )?creative commons attribution share ?alike 3 0( unported)?( licen[cs]e)?
cc-by-nc-4.0 | creative commons attribution 4 0 under | under (a |the )?creative commons attribution non ?commercial 4 0( international)?( licen[cs]e)?
cc-by-nc-sa-4.0 | creative commons attribution 4 0 under | under (a |the )?creative commons attribution non ?commercial share ?alike 4 0( international)?( licen[cs]e)?
cc-by-nd-4.0 | creative commons attribution 4 0 under | under (a |the )?creative commons attribution no ?deriv(ative)?s 4 0( international)?( licen[cs]e)?
cc-by-nc-nd-4.0 | creative commons attribution 4 0 under | under (a |the )?creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( licen[cs]e)?
odbl-1.0 | open database under | under (the )?(terms of )?(the )?open (data commons )?(open )?database licen[cs]e
odc-by-1.0 | open data commons attribution | under (the )?open data commons attribution licen[cs]e
ofl-1.1 | sil open font | licensed under the sil open font licen[cs]e( version 1 1)?
postgresql | postgresql under | (licensed|released|distributed) under (the )?postgresql licen[cs]e
busl-1.1 | business source | (licensed|released|governed|distributed) (under|by) (the )?business source licen[cs]e( 1 1)?
sspl-1.0 | server side public under | under (the )?(terms of )?(the )?server side public licen[cs]e
elastic-2.0 | elastic under | under (the )?(terms of )?(the )?elastic licen[cs]e( 2 0| v2)?
cecill-2.1 | cecill governed | this software is governed by the cecill( [bc])? licen[cs]e
proprietary | proprietary confidential | (this (document|software|text) is |strictly )?proprietary and confidential
proprietary | rights reserved reproduced | all rights reserved no part of this (publication|work|book|document) may be reproduced
public-domain | public domain | (is|are|was|were|been) (hereby )?(dedicated|released|placed|put) (to|into|in) the public domain
ogl-3.0 | open government contains | contains public sector information licensed under the open government licen[cs]e( v3 0)?
"""

WORDING = r"""
mit | permission granted free charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | software as is warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc | permission fee granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission fee granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-2-clause | redistributions binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd | redistribution source binary | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither name endorse | neither the name of .{0,120}? may be used to endorse or promote products
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | law agreed basis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | contributor perpetual worldwide | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
gpl | redistribute modify gnu | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | hope useful warranty | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general
gpl | copy gnu general along | you should have received a copy of the gnu general public licen[cs]e along with
lgpl | redistribute modify gnu | you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[cs]e
lgpl | copy gnu lesser along | you should have received a copy of the gnu lesser general public licen[cs]e along with
agpl-3.0 | copy gnu affero along | you should have received a copy of the gnu affero general public licen[cs]e along with
agpl-3.0 | interacting remotely network | all users interacting with it remotely through a computer network
gpl-3.0 | convey modifications produce | you may convey a work based on the program or the modifications to produce it from the program
gpl-2.0 | activities copying distribution modification | activities other than copying distribution and modification are not covered by this license
gfdl-1.3 | invariant sections cover | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | copy mpl distributed | if a copy of the mpl was not distributed with this file you can obtain one at
epl-1.0 | eclipse foundation agreement steward | the eclipse foundation is the initial agreement steward
unlicense | free unencumbered domain | this is free and unencumbered software released into the public domain
unlicense | anyone copy modify publish | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | fuck want | you just do what the fuck you want to
wtfpl | fuck want public | do what the fuck you want to public licen[cs]e
zlib | authors held liable damages | in no event will the authors be held liable for any damages arising from the use of this software
zlib | origin misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | machine executable object | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
artistic-1.0 | copyright holder artistic control | such that the copyright holder maintains some semblance of artistic control
ofl-1.1 | fonts derivatives released | the fonts and derivatives however cannot be released under any other type of license
ofl-1.1 | reserved font | with reserved font names?
cc0-1.0 | work public domain rights | the person who associated a work with this deed has dedicated the work to the public domain by waiving all of (his or her|their) rights
cc-by | credit indicate changes | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | remix transform contributions | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nc | material commercial purposes | you may not use the material for commercial purposes
cc-by-nd | remix transform distribute modified | if you remix transform or build upon the material you may not distribute the modified material
openssl | product includes openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
apache-1.1 | product includes apache foundation | this product includes software developed by the apache software foundation
json | software shall good evil | the software shall be used for good not evil
beerware | beer meet worth | if we meet some day and you think this stuff is worth it you can buy me a beer
ncsa | university illinois ncsa | university of illinois ncsa open source licen[cs]e
postgresql | university california liable | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
busl-1.1 | change date anniversary | effective on the change date or the fourth anniversary of the first publicly available distribution
sspl-1.0 | service functionality | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | hosted managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | grant rights sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
openrail-m | use model derivatives | you agree not to use the model or derivatives of the model
llama | llama community | llama (2|3|3 1|3 2|3 3|4) community licen[cs]e agreement
proprietary | unauthorized copying prohibited | unauthorized copying of this file via any medium is strictly prohibited
"""

TITLE = r"""
gpl-1.0 | gnu general 1 | gnu general public licen[cs]e (version |v )1( 0)?
gpl-2.0 | gnu general 2 | gnu general public licen[cs]e (version |v )?2( 0)?
gpl-3.0 | gnu general 3 | gnu general public licen[cs]e (version |v )?3( 0)?
gpl-2.0 | gnu gpl 2 | gnu gpl (version |v )?2( 0)?
gpl-3.0 | gnu gpl 3 | gnu gpl (version |v )?3( 0)?
gpl-2.0 | gpl 2 | gpl (version |v )?2( 0)?
gpl-3.0 | gpl 3 | gpl (version |v )?3( 0)?
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gplv3 | gplv3
lgpl-2.0 | gnu library general | gnu library general public licen[cs]e( version)?( 2)?( 0)?
lgpl-2.1 | gnu lesser 2 1 | gnu lesser general public licen[cs]e (version |v )?2 1
lgpl-3.0 | gnu lesser 3 | gnu lesser general public licen[cs]e (version |v )?3( 0)?
lgpl-2.1 | lgpl 2 1 | lgpl (version |v )?2 1
lgpl-3.0 | lgpl 3 | lgpl (version |v )?3( 0)?
lgpl-3.0 | lgplv3 | lgplv3
agpl-3.0 | gnu affero 3 | gnu affero general public licen[cs]e (version |v )?3( 0)?
agpl-3.0 | agpl 3 | agpl (version |v )?3( 0)?
agpl-3.0 | agplv3 | agplv3
gfdl-1.3 | gnu documentation 1 | gnu free documentation licen[cs]e (version )?1 [123]
apache-1.0 | apache 1 0 | apache (software )?licen[cs]e (version |v )?1 0
apache-1.1 | apache 1 1 | apache (software )?licen[cs]e (version |v )?1 1
apache-2.0 | apache 2 | apache (software )?licen[cs]e (version |v )?2( 0)?
apache-2.0 | apache 2 0 | apache (version |v )?2 0
bsd-2-clause | bsd 2 clause | bsd 2 clause( licen[cs]e)?
bsd-3-clause | bsd 3 clause | bsd 3 clause( licen[cs]e)?
bsd-4-clause | bsd 4 clause | bsd 4 clause( licen[cs]e)?
bsd-2-clause | simplified bsd | simplified bsd licen[cs]e
bsd-3-clause | bsd | (new|modified|revised) bsd licen[cs]e
mit-0 | mit no attribution | mit no attribution( licen[cs]e)?
x11 | x11 | x11 licen[cs]e
mpl-1.0 | mozilla 1 0 | mozilla public licen[cs]e (version |v )?1 0
mpl-1.1 | mozilla 1 1 | mozilla public licen[cs]e (version |v )?1 1
mpl-2.0 | mozilla 2 0 | mozilla public licen[cs]e (version |v )?2 0
mpl-2.0 | mpl 2 0 | mpl (version |v )?2 0
epl-1.0 | eclipse 1 0 | eclipse public licen[cs]e (version |v )?1 0
epl-2.0 | eclipse 2 0 | eclipse public licen[cs]e (version |v )?2 0
cddl-1.0 | common development distribution | common development and distribution licen[cs]e( version)?( 1 0)?
cddl-1.1 | common development distribution 1 1 | common development and distribution licen[cs]e (version )?1 1
cpl-1.0 | common public 1 0 | common public licen[cs]e (version )?1 0
eupl-1.1 | european union public 1 1 | european union public licen[cs]e (version |v )?1 1
eupl-1.2 | european union public 1 2 | european union public licen[cs]e (version |v )?1 2
cecill-b | cecill b | cecill b
cecill-c | cecill c | cecill c
osl-3.0 | open software 3 0 | open software licen[cs]e (version |v )?3 0
afl-3.0 | academic free 3 0 | academic free licen[cs]e (version |v )?3 0
artistic-1.0 | artistic 1 0 | artistic licen[cs]e (version )?1 0
artistic-2.0 | artistic 2 0 | artistic licen[cs]e (version )?2 0
bsl-1.0 | boost software 1 0 | boost software licen[cs]e (version )?1 0
busl-1.1 | business source 1 1 | business source licen[cs]e (version )?1 1
zpl-2.1 | zope public 2 | zope public licen[cs]e (version )?2 [01]
php-3.01 | php 3 | php licen[cs]e (version )?3 0?[01]
ofl-1.1 | sil font 1 1 | sil open font licen[cs]e (version )?1 1
cc0-1.0 | cc0 1 0 | cc0 1 0( universal)?
cc-by-1.0 | cc by 1 0 | cc by 1 0
cc-by-2.0 | cc by 2 | cc by 2 [05]
cc-by-3.0 | cc by 3 0 | cc by 3 0
cc-by-4.0 | cc by 4 0 | cc by 4 0
cc-by-sa-2.0 | cc sa 2 | cc by sa 2 [05]
cc-by-sa-3.0 | cc sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | cc sa 4 0 | cc by sa 4 0
cc-by-nc-2.0 | cc nc 2 | cc by nc 2 [05]
cc-by-nc-3.0 | cc nc 3 0 | cc by nc 3 0
cc-by-nc-4.0 | cc nc 4 0 | cc by nc 4 0
cc-by-nc-sa-3.0 | cc nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc nc sa 4 0 | cc by nc sa 4 0
cc-by-nd-3.0 | cc nd 3 0 | cc by nd 3 0
cc-by-nd-4.0 | cc nd 4 0 | cc by nd 4 0
cc-by-nc-nd-3.0 | cc nc nd 3 0 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc nc nd 4 0 | cc by nc nd 4 0
ogl-3.0 | open government 3 0 | open government licen[cs]e (version |v )?3 0
etalab-2.0 | licence ouverte 2 0 | licence ouverte( open licence)? (version )?2 0
dl-de-by-2.0 | datenlizenz deutschland namensnennung | datenlizenz deutschland namensnennung( version)?( 2 0)?
openrail-m | openrail m | (creativeml |bigscience )?openrail m
"""

ADDRESS = r"""
gpl-2.0 | gnu org licenses 2 0 | gnu org licenses (old licenses )?gpl 2 0( html| txt)?
gpl-3.0 | gnu org licenses 3 0 | gnu org licenses gpl 3 0( html| txt)?
gpl | gnu org licenses | gnu org licenses( gpl)?
lgpl-2.1 | gnu org licenses lgpl 2 1 | gnu org licenses (old licenses )?lgpl 2 1( html| txt)?
lgpl-3.0 | gnu org licenses lgpl 3 0 | gnu org licenses lgpl 3 0( html| txt)?
agpl-3.0 | gnu org licenses agpl | gnu org licenses agpl( 3 0)?( html| txt)?
gfdl-1.3 | gnu org licenses fdl | gnu org licenses fdl( 1 [123])?( html| txt)?
apache-2.0 | apache org licenses 2 0 | apache org licenses license 2 0( html| txt)?
mit | opensource org mit | opensource org licenses? mit( license)?( php| html)?
bsd-2-clause | opensource org bsd 2 | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource org bsd 3 | opensource org licenses? bsd 3 clause
isc | opensource org isc | opensource org licenses? isc
mpl-2.0 | mozilla org mpl 2 0 | mozilla org (en us )?mpl 2 0
epl-1.0 | eclipse org epl | eclipse org legal epl v10( html)?
epl-2.0 | eclipse org epl | eclipse org legal epl (v20|2 0)( html)?
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | wtfpl net
bsl-1.0 | boost org license | boost org license 1 0 txt
cc0-1.0 | creativecommons org zero | creativecommons org publicdomain zero( 1 0)?
public-domain | creativecommons org mark | creativecommons org publicdomain mark( 1 0)?
cc-by-4.0 | creativecommons org by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org by 3 0 | creativecommons org licenses by 3 0
cc-by-2.0 | creativecommons org by 2 | creativecommons org licenses by 2 [05]
cc-by-sa-4.0 | creativecommons org sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | creativecommons org nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | creativecommons org nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nd-4.0 | creativecommons org nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-nd-4.0 | creativecommons org nc nd 4 0 | creativecommons org licenses by nc nd 4 0
odbl-1.0 | opendatacommons org odbl | opendatacommons org licenses odbl( 1 0)?
odc-by-1.0 | opendatacommons org by | opendatacommons org licenses by( 1 0)?
pddl-1.0 | opendatacommons org pddl | opendatacommons org licenses pddl( 1 0)?
ofl-1.1 | scripts sil org ofl | scripts sil org ofl
ogl-3.0 | nationalarchives open government | nationalarchives gov uk doc open government licence( version 3)?
"""

MENTION = r"""
gpl | gnu general | gnu general public licen[cs]e
gpl | gnu gpl | gnu gpl
gpl | gpl | gpl
lgpl | gnu lesser general | gnu lesser general public licen[cs]e
lgpl | lgpl | lgpl
agpl-3.0 | affero general | (gnu )?affero general public licen[cs]e
agpl-3.0 | agpl | agpl
gfdl-1.3 | gnu documentation | gnu free documentation licen[cs]e
apache | apache license | apache (software )?license
apache | apache licence | apache (software )?licence
mit | mit license | mit license
mit | mit licence | mit licence
mit | expat | expat licen[cs]e
bsd | bsd license | bsd( style)? license
bsd | bsd licence | bsd( style)? licence
isc | isc | isc licen[cs]e
mpl | mozilla public | mozilla public licen[cs]e
epl | eclipse public | eclipse public licen[cs]e
cddl | cddl | cddl
eupl | eupl | eupl
cecill | cecill | cecill
artistic | artistic | artistic licen[cs]e
bsl-1.0 | boost software | boost software licen[cs]e
zlib | zlib | zlib licen[cs]e
unlicense | unlicense | (the )?unlicense
wtfpl | wtfpl | wtfpl
sspl-1.0 | server side public | server side public licen[cs]e
elastic-2.0 | elastic | elastic licen[cs]e
busl-1.1 | business source | business source licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
python-2.0 | psf | psf licen[cs]e( agreement)?
openssl | openssl | openssl licen[cs]e
ofl-1.1 | open font | (sil )?open font licen[cs]e
odbl-1.0 | open database | open database licen[cs]e
cc0-1.0 | cc0 | (cc )?cc0
cc-by-nc-nd | cc nc nd | cc by nc nd
cc-by-nc-sa | cc nc sa | cc by nc sa
cc-by-nc | cc nc | cc by nc
cc-by-nd | cc nd | cc by nd
cc-by-sa | cc sa | cc by sa
cc-by | cc by | cc by
cc-by | creative commons attribution | creative commons attribution( licen[cs]e)?
cc-by-sa | creative commons attribution | creative commons attribution share ?alike( licen[cs]e)?
cc-by-nc | creative commons attribution | creative commons attribution non ?commercial( licen[cs]e)?
cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(ative)?s( licen[cs]e)?
cc-by | creative commons namensnennung | creative commons namensnennung( lizenz)?
cc-by-sa | creative commons namensnennung | creative commons namensnennung weitergabe unter gleichen bedingungen
cc-by | creative commons paternité | creative commons paternité
cc-by | creative commons reconocimiento | creative commons reconocimiento
public-domain | public domain | (in |into )?the public domain
public-domain | domaine public | (dans )?le domaine public
public-domain | dominio público | (en )?el dominio público
public-domain | gemeinfrei | gemeinfrei
all-rights-reserved | rights reserved | all rights reserved
all-rights-reserved | rechte vorbehalten | alle rechte vorbehalten
all-rights-reserved | droits réservés | tous droits réservés
all-rights-reserved | derechos reservados | todos los derechos reservados
"""

TEXTS = {
    "identifier": IDENTIFIER, "grant": GRANT, "wording": WORDING, "title": TITLE,
    "address": ADDRESS, "mention": MENTION,
}
