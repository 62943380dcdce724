"""Hand-written signatures of licenses.

A line holds: priority, label, weight, gating words (``|`` between them), pattern. Patterns are regular expressions over normalised words (small letters and
digits, one blank between words) and match whole words. Each match holds a word that starts with one of the gating words, so a rule runs only where such a word stands.
Higher priorities decide first: 100 tags, 90 the license's own words, 80 grants that name it, 70 titles with their version, 60 short names with their version, 50 titles without
one, 40 short names in a phrase of use, 30 notices of any kind.
"""

from __future__ import annotations

SIGNATURES = r"""
100 mit 1.0 spdx spdx license identifier mit
100 mit-0 1.0 spdx spdx license identifier mit 0
100 apache-1 1.0 spdx spdx license identifier apache 1 [01]
100 apache-2 1.0 spdx spdx license identifier apache 2 0
100 gpl-1 1.0 spdx spdx license identifier gpl 1 0(?: only| or later)?
100 gpl-2 1.0 spdx spdx license identifier gpl 2 0(?: only| or later)?
100 gpl-3 1.0 spdx spdx license identifier gpl 3 0(?: only| or later)?
100 lgpl-2 1.0 spdx spdx license identifier lgpl 2 0(?: only| or later)?
100 lgpl-2.1 1.0 spdx spdx license identifier lgpl 2 1(?: only| or later)?
100 lgpl-3 1.0 spdx spdx license identifier lgpl 3 0(?: only| or later)?
100 agpl-3 1.0 spdx spdx license identifier agpl 3 0(?: only| or later)?
100 bsd-0 1.0 spdx spdx license identifier 0bsd
100 bsd-1 1.0 spdx spdx license identifier bsd 1 clause
100 bsd-2 1.0 spdx spdx license identifier bsd 2 clause(?: patent| views)?
100 bsd-3 1.0 spdx spdx license identifier bsd 3 clause(?: clear| lbnl)?
100 bsd-4 1.0 spdx spdx license identifier bsd 4 clause(?: uc)?
100 isc 1.0 spdx spdx license identifier isc
100 zlib 1.0 spdx spdx license identifier (?:zlib|libpng)(?: acknowledgement| 2 0)?
100 boost-1 1.0 spdx spdx license identifier bsl 1 0
100 mpl-1.1 1.0 spdx spdx license identifier mpl 1 [01]
100 mpl-2 1.0 spdx spdx license identifier mpl 2 0(?: no copyleft exception)?
100 epl-1 1.0 spdx spdx license identifier epl 1 0
100 epl-2 1.0 spdx spdx license identifier epl 2 0
100 cddl-1 1.0 spdx spdx license identifier cddl 1 [01]
100 eupl-1 1.0 spdx spdx license identifier eupl 1 [012]
100 artistic-2 1.0 spdx spdx license identifier artistic 2 0
100 unlicense 1.0 spdx spdx license identifier unlicense
100 wtfpl 1.0 spdx spdx license identifier wtfpl
100 python-2 1.0 spdx spdx license identifier (?:python|psf) 2 0
100 ofl-1.1 1.0 spdx spdx license identifier ofl 1 [01](?: rfn| no rfn)?
100 cc0 1.0 spdx spdx license identifier cc0 1 0
100 cc-by 1.0 spdx spdx license identifier cc by [1-4] [05]
100 cc-by-sa 1.0 spdx spdx license identifier cc by sa [1-4] [05]
100 cc-by-nc 1.0 spdx spdx license identifier cc by nc [1-4] [05]
100 cc-by-nd 1.0 spdx spdx license identifier cc by nd [1-4] [05]
100 cc-by-nc-sa 1.0 spdx spdx license identifier cc by nc sa [1-4] [05]
100 cc-by-nc-nd 1.0 spdx spdx license identifier cc by nc nd [1-4] [05]
100 odbl 1.0 spdx spdx license identifier odbl 1 0
100 other 0.8 spdx spdx license identifier [a-z0-9]+
90 mit 0.95 permission permission is hereby granted free of charge to any person obtaining a copy
90 mit 0.8 copies the above copyright notice and this permission notice shall be included in all copies or substantial portions
90 mit 0.6 merchantability the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
90 isc 0.95 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
90 isc 0.7 author the software is provided as is and the author disclaims all warranties
90 bsd 0.9 redistribution redistribution and use in source and binary forms with or without modification are permitted
90 bsd-3 0.9 endorse neither the names? of (?:[a-z0-9]+ ){1,12}contributors may be used to endorse or promote products
90 bsd-4 0.9 advertising all advertising materials mentioning features or use of this software must display
90 bsd 0.7 redistributions redistributions of source code must retain the above copyright notice
90 bsd 0.7 redistributions redistributions in binary form must reproduce the above copyright notice
90 apache-2 0.95 licensed licensed under the apache license version 2 0 the license you may not use this file except in compliance
90 apache-2 0.7 unless unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
90 apache-2 0.9 apache terms and conditions for use reproduction and distribution apache
90 gpl-2 0.95 redistribute you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
90 gpl-3 0.95 redistribute you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
90 lgpl-2.1 0.95 redistribute you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
90 lgpl-3 0.95 redistribute you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
90 lgpl-2 0.95 redistribute you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2
90 agpl-3 0.95 redistribute you can redistribute it and or modify it under the terms of the gnu affero general public license
90 gpl 0.7 redistribute this program is free software you can redistribute it and or modify it
90 gpl 0.6 foundation published by the free software foundation either version
90 mpl-2 0.95 source this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
90 mpl-1.1 0.95 mozilla the contents of this file are subject to the mozilla public license version 1 [01]
90 zlib 0.9 origin the origin of this software must not be misrepresented
90 zlib 0.8 warranty this software is provided as is without any express or implied warranty
90 boost-1 0.95 boost distributed under the boost software license version 1 0
90 unlicense 0.95 unencumbered this is free and unencumbered software released into the public domain
90 wtfpl 0.95 everyone everyone is permitted to copy and distribute verbatim or modified copies
90 epl-2 0.95 eclipse this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0
90 epl-1 0.95 eclipse this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
90 cddl-1 0.95 common the contents of this file are subject to the terms of the common development and distribution license
90 artistic-1 0.9 package the intent of this document is to state the conditions under which a package may be copied
90 ofl-1.1 0.95 font this font software is licensed under the sil open font license version 1 1
90 cc0 0.9 waive to the extent possible under law (?:[a-z0-9]+ ){1,8}has waived all copyright and related or neighboring rights
90 cc-by-sa 0.9 commons this work is licensed under (?:a|the) creative commons attribution share ?alike
90 cc-by-nc-nd 0.9 commons this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)
90 cc-by-nc-sa 0.9 commons this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike
90 cc-by-nc 0.9 commons this work is licensed under (?:a|the) creative commons attribution non ?commercial
90 cc-by-nd 0.9 commons this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:s|atives|ative works)
90 cc-by 0.9 commons this work is licensed under (?:a|the) creative commons attribution
90 python-2 0.9 psf psf is making python available to licensee on an as is basis
90 openssl 0.9 openssl this product includes software developed by the openssl project
90 postgresql 0.8 postgresql portions copyright (?:c )?(?:[0-9]+ )*the postgresql global development group
90 gfdl-1 0.9 documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
90 beerware 0.9 beer if we meet some day and you think this stuff is worth it you can buy me a beer
90 json 0.9 evil the software shall be used for good not evil
90 sspl-1 0.9 service if you make the functionality of the program or a modified version available to third parties as a service
90 bsl-1.1 0.9 licensor the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
80 mit 0.95 mit|expat (?:re)?licensed under (?:the )?(?:terms of the )?(?:mit|expat)(?: x11)?(?: licen[cs]e)?
80 mit 0.95 mit|expat (?:released|distributed|available|published|provided|made available) under (?:the )?(?:terms of the )?(?:mit|expat)(?: licen[cs]e)?
80 mit 0.9 mit under (?:the )?(?:terms (?:of|and conditions of) the )?mit licen[cs]e
80 apache-2 0.95 apache (?:re)?licensed under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?
80 apache-2 0.95 apache (?:released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?
80 apache 0.8 apache (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e
80 gpl-2 0.95 gpl|gnu (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?2(?: 0)?
80 gpl-2 0.9 gplv2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gplv2
80 gpl-3 0.95 gpl|gnu (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?3(?: 0)?
80 gpl-3 0.9 gplv3 (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gplv3
80 gpl 0.8 gpl|gnu (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl|general public licen[cs]e)
80 lgpl-2.1 0.95 lgpl|lesser (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?2 1
80 lgpl-3 0.95 lgpl|lesser (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?3(?: 0)?
80 lgpl 0.8 lgpl|lesser (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)
80 agpl-3 0.95 agpl|affero (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:agpl|affero general public licen[cs]e)(?:(?: version| v)? ?3(?: 0)?)?
80 bsd-2 0.95 bsd|simplified|freebsd (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: licen[cs]e)?
80 bsd-3 0.95 bsd|new|modified (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
80 bsd 0.8 bsd (?:licensed|released|distributed|available|provided) under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: licen[cs]e)?
80 isc 0.9 isc (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?isc(?: licen[cs]e)?
80 zlib 0.9 zlib (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?zlib(?: libpng)?(?: licen[cs]e)?
80 boost-1 0.9 boost (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?boost(?: software)? licen[cs]e
80 mpl-2 0.95 mpl|mozilla (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?2(?: 0)?
80 mpl-1.1 0.95 mpl|mozilla (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?1(?: [01])?
80 epl-2 0.95 epl|eclipse (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:epl|eclipse public licen[cs]e)(?: version| v)? ?2(?: 0)?
80 epl-1 0.95 epl|eclipse (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:epl|eclipse public licen[cs]e)(?: version| v)? ?1(?: 0)?
80 cddl-1 0.9 cddl|common (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:cddl|common development and distribution licen[cs]e)
80 eupl-1 0.9 eupl|european (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:eupl|european union public licen[cs]e)
80 artistic-2 0.9 artistic (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?artistic licen[cs]e(?: version)? 2(?: 0)?
80 perl 0.8 perl under the same terms as perl(?: itself| 5)?
80 ruby 0.8 ruby (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?ruby(?: s)? licen[cs]e
80 python-2 0.9 psf|python (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:psf|python software foundation) licen[cs]e
80 php-3 0.9 php (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?php licen[cs]e
80 unlicense 0.9 unlicense (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?unlicense
80 wtfpl 0.9 wtfpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?wtfpl
80 ofl-1.1 0.9 ofl|font (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:sil )?(?:ofl|open font licen[cs]e)
80 cc0 0.95 cc0 (?:licensed|released|distributed|available|dedicated) (?:under|with|to) (?:the )?(?:creative commons )?cc0
80 cc-by 0.9 cc (?:licensed|released|distributed|available|published|shared) under (?:a |the )?cc by(?: licen[cs]e)?
80 cc-by-sa 0.95 cc (?:licensed|released|distributed|available|published|shared) under (?:a |the )?cc by sa(?: licen[cs]e)?
80 cc-by-nc 0.95 cc (?:licensed|released|distributed|available|published|shared) under (?:a |the )?cc by nc(?: licen[cs]e)?
80 cc-by-nd 0.95 cc (?:licensed|released|distributed|available|published|shared) under (?:a |the )?cc by nd(?: licen[cs]e)?
80 cc-by-nc-sa 0.95 cc (?:licensed|released|distributed|available|published|shared) under (?:a |the )?cc by nc sa(?: licen[cs]e)?
80 cc-by-nc-nd 0.95 cc (?:licensed|released|distributed|available|published|shared) under (?:a |the )?cc by nc nd(?: licen[cs]e)?
80 odbl 0.9 odbl|database (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:odbl|open database licen[cs]e)
80 sspl-1 0.9 sspl|server (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:sspl|server side public licen[cs]e)
80 elastic-2 0.9 elastic (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?elastic licen[cs]e
80 gfdl-1 0.9 gfdl|documentation (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:gfdl|free documentation licen[cs]e)
80 isc 0.8 isc subject to the (?:terms of the )?isc(?: licen[cs]e)?
80 mit 0.8 mit subject to the (?:terms of the )?mit(?: licen[cs]e)?
80 bsd 0.8 bsd subject to the (?:terms of the )?bsd(?: licen[cs]e)?
70 apache-2 0.9 apache apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
70 apache-1 0.8 apache apache(?: software)? licen[cs]e(?: version| v)? ?1(?: [01])?
70 gpl-1 0.8 general (?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?
70 gpl-2 0.9 general (?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?(?: only| or later| or any later version)?
70 gpl-3 0.9 general (?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?(?: only| or later| or any later version)?
70 lgpl-2 0.9 library (?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?
70 lgpl-2.1 0.9 lesser (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1
70 lgpl-3 0.9 lesser (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?
70 agpl-3 0.9 affero (?:gnu )?affero general public licen[cs]e(?:(?: version| v)? ?3(?: 0)?)?
70 mpl-1.1 0.9 mozilla mozilla public licen[cs]e(?: version| v)? ?1(?: [01])?
70 mpl-2 0.9 mozilla mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
70 epl-1 0.9 eclipse eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
70 epl-2 0.9 eclipse eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
70 edl-1 0.9 eclipse eclipse distribution licen[cs]e(?: version| v)? ?1(?: 0)?
70 cddl-1 0.9 common common development and distribution licen[cs]e(?:(?: version| v)? ?1(?: [01])?)?
70 cpl-1 0.9 common common public licen[cs]e(?: version| v)? ?1(?: 0)?
70 eupl-1 0.9 european european union public licen[cs]e(?:(?: version| v)? ?1(?: [012])?)?
70 artistic-1 0.9 artistic artistic licen[cs]e(?: version| v)? ?1(?: 0)?
70 artistic-2 0.9 artistic artistic licen[cs]e(?: version| v)? ?2(?: 0)?
70 boost-1 0.9 boost boost software licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?
70 ofl-1.1 0.9 font (?:sil )?open font licen[cs]e(?:(?: version| v)? ?1(?: [01])?)?
70 python-2 0.8 python python(?: software foundation)? licen[cs]e(?: version| v)? ?2(?: 0)?
70 php-3 0.8 php php licen[cs]e(?: version| v)? ?3(?: 0?1| 0)?
70 gfdl-1 0.9 documentation (?:gnu )?free documentation licen[cs]e(?:(?: version| v)? ?1(?: [123])?)?
70 odbl 0.9 database open database licen[cs]e(?: 1 0)?
70 odc-by 0.9 commons open data commons attribution(?: licen[cs]e)?
70 pddl 0.9 dedication public domain dedication and licen[cs]e
70 bsl-1.1 0.9 business business source licen[cs]e(?: 1 1)?
70 sspl-1 0.9 server server side public licen[cs]e(?:(?: version| v)? ?1)?
70 elastic-2 0.8 elastic elastic licen[cs]e(?: 2 0| v2)?
70 ms-pl 0.9 microsoft microsoft public licen[cs]e
70 ms-rl 0.9 microsoft microsoft reciprocal licen[cs]e
70 cc0 0.9 zero creative commons zero(?: 1 0)?
70 cc-by-sa 0.9 creative creative commons attribution share ?alike(?: [1-4] [05])?
70 cc-by-nc-sa 0.9 creative creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
70 cc-by-nc-nd 0.9 creative creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?
70 cc-by-nc 0.9 creative creative commons attribution non ?commercial(?: [1-4] [05])?
70 cc-by-nd 0.9 creative creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?
70 cc-by 0.8 creative creative commons attribution(?: [1-4] [05])?
70 wtfpl 0.9 fuck do what the fuck you want to public licen[cs]e
70 unlicense 0.8 unlicense the unlicense
60 apache-2 0.7 apache apache ?(?:v ?)?2(?: 0)?
60 gpl-2 0.7 gpl gpl ?(?:v ?|version )?2(?: 0)?(?: only| or later)?
60 gpl-2 0.7 gplv2 gplv2(?: only| or later)?
60 gpl-3 0.7 gpl gpl ?(?:v ?|version )?3(?: 0)?(?: only| or later)?
60 gpl-3 0.7 gplv3 gplv3(?: only| or later)?
60 lgpl-2.1 0.7 lgpl lgpl ?(?:v ?|version )?2 1(?: only| or later)?
60 lgpl-2 0.7 lgpl lgpl ?(?:v ?|version )?2(?: 0)?(?: only| or later)?
60 lgpl-3 0.7 lgpl lgpl ?(?:v ?|version )?3(?: 0)?(?: only| or later)?
60 agpl-3 0.7 agpl agpl ?(?:v ?|version )?3(?: 0)?(?: only| or later)?
60 bsd-2 0.7 bsd (?:bsd 2 clause|2 clause bsd|simplified bsd)
60 bsd-3 0.7 bsd (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)
60 bsd-4 0.7 bsd (?:bsd 4 clause|4 clause bsd|original bsd)
60 bsd-0 0.7 bsd|0bsd (?:0bsd|zero clause bsd|bsd 0 clause)
60 mpl-2 0.7 mpl mpl ?(?:v ?|version )?2(?: 0)?
60 mpl-1.1 0.7 mpl mpl ?(?:v ?|version )?1(?: [01])?
60 epl-2 0.7 epl epl ?(?:v ?|version )?2(?: 0)?
60 epl-1 0.7 epl epl ?(?:v ?|version )?1(?: 0)?
60 cddl-1 0.7 cddl cddl ?(?:v ?|version )?1(?: [01])?
60 eupl-1 0.7 eupl eupl ?(?:v ?|version )?1(?: [012])?
60 boost-1 0.7 bsl bsl 1 0
60 bsl-1.1 0.7 busl busl 1 1
60 ofl-1.1 0.7 ofl ofl ?(?:v ?|version )?1(?: [01])?
60 gfdl-1 0.7 gfdl gfdl ?(?:v ?|version )?1(?: [123])?
60 cc0 0.7 cc0 cc0(?: 1 0)?
60 cc-by 0.6 cc cc by(?: [1-4] [05])?
60 cc-by-sa 0.8 cc cc by sa(?: [1-4] [05])?
60 cc-by-nc 0.8 cc cc by nc(?: [1-4] [05])?
60 cc-by-nd 0.8 cc cc by nd(?: [1-4] [05])?
60 cc-by-nc-sa 0.8 cc cc by nc sa(?: [1-4] [05])?
60 cc-by-nc-nd 0.8 cc cc by nc nd(?: [1-4] [05])?
60 sspl-1 0.7 sspl sspl(?: 1(?: 0)?)?
60 odbl 0.7 odbl odbl(?: 1 0)?
60 ms-pl 0.7 ms ms pl
60 mit-0 0.7 mit mit (?:0|no attribution)
50 gpl 0.6 general (?:gnu )?general public licen[cs]e
50 lgpl 0.6 lesser|library (?:gnu )?(?:lesser|library) general public licen[cs]e
50 apache 0.6 apache apache(?: software)? licen[cs]e
50 mpl 0.6 mozilla mozilla public licen[cs]e
50 epl 0.6 eclipse eclipse public licen[cs]e
50 artistic 0.6 artistic artistic licen[cs]e
50 mit 0.6 mit|expat (?:mit|expat)(?: x11)?(?: style)? licen[cs]ed?
50 bsd 0.6 bsd bsd(?: style)? licen[cs]ed?
50 isc 0.6 isc isc licen[cs]ed?
50 zlib 0.6 zlib zlib(?: libpng)? licen[cs]ed?
50 php 0.5 php php licen[cs]e
50 ruby 0.5 ruby ruby licen[cs]e
50 openssl 0.5 openssl openssl licen[cs]e
50 postgresql 0.6 postgresql postgresql licen[cs]e
50 python 0.5 python python(?: software foundation)? licen[cs]e
50 creative-commons 0.4 creative creative commons
40 mit 0.5 mit licen[cs]e (?:is )?(?:the )?mit
40 isc 0.5 isc (?:licen[cs]e (?:is )?|or |and )isc
40 bsd 0.5 bsd (?:licen[cs]e (?:is )?|or |and |under (?:the )?)bsd
40 gpl 0.5 gpl (?:licen[cs]e (?:is )?|or |and |under (?:the )?|of (?:the )?)gpl
40 lgpl 0.5 lgpl (?:licen[cs]e (?:is )?|or |and |under (?:the )?|of (?:the )?)lgpl
40 mit 0.5 mit (?:or|and) mit
40 gpl 0.5 gpl gpl licen[cs]ed?
30 public-domain 0.6 domain (?:released into|dedicated to|placed in|in) the public domain
30 proprietary 0.8 confidential proprietary and confidential
30 proprietary 0.7 unauthori unauthori[sz]ed copying of this (?:file|software|document)
30 proprietary 0.5 reserved all rights reserved
30 proprietary 0.6 permission may not be (?:copied|reproduced|redistributed)(?: or (?:copied|reproduced|redistributed))? without (?:the )?(?:prior |express |written )*permission
30 commercial 0.6 commercial commercial licen[cs]e (?:agreement|required)
30 eula 0.7 end end user licen[cs]e agreement
30 non-commercial 0.6 non for non ?commercial (?:use|purposes)(?: only)?
30 other 0.3 license licensed under (?:the )?terms? (?:of|in) the license file
"""


def signature_rules() -> list[tuple[int, str, float, tuple[str, ...], str]]:
    """The rules in order: priority, label, weight, gating words, pattern."""
    rules = []
    for line in SIGNATURES.strip().split("\n"):
        priority, label, weight, words, pattern = line.split(" ", 4)
        rules.append((int(priority), label, float(weight), tuple(words.split("|")), pattern))
    return sorted(rules, key=lambda r: -r[0])
