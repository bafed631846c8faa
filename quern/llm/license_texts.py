"""Licence signatures written out one by one: sentences of licence texts, notices and headers.

Each is (label, priority, confidence, keywords, pattern) like a :class:`~.license_rules.Rule`,
over the same normalised words. Priority 1 marks sentences that only this licence has, 2
notices that name it in passing, 3 sentences that several licences of a kind share.
"""

from __future__ import annotations

#: A few words of somebody's own, such as a holder or a project.
SOME = "(?:[^ ]+ ){0,8}?"
LIC = "licen[sc]es?"

# Wording of published licences.
TEXTS: list[tuple[str, int, float, str, str]] = [
    # permissive
    ("mit", 1, 0.98, "permission is|permission to use", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, 0.8, "deal in the software", "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", 2, 0.85, "above copyright", "(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, 0.75, "software is provided", "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 2, 0.9, "mit lic", f"mit {LIC} (?:see|file|text|header|terms|applies|c|copyright)"),
    ("mit", 2, 0.85, "released as mit|released with mit|licensed as mit|licensed with mit|distributed as mit|distributed with mit|available as mit|available with mit", "(?:released|licensed|distributed|available) (?:as|with) mit"),
    ("mit-0", 1, 0.97, "permission is|permission to use", "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction"),
    ("isc", 1, 0.97, "permission is|permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", 1, 0.97, "permission is|permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("isc", 2, 0.8, "author disclaims", "author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd", 1, 0.95, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", 3, 0.8, "redistributions", "redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, 0.8, "redistributions", "redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", 1, 0.95, "neither the name", f"neither the names? of {SOME}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", 2, 0.9, "names of", "names of (?:its|their|any) contributors may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 1, 0.97, "advertising materials", "advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", 2, 0.9, "views and conclusions", "views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd", 3, 0.7, "in no event", f"in no event shall {SOME}(?:copyright )?(?:holders?|owners?|regents|authors?|contributors) (?:or contributors )?be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause-clear", 1, 0.97, "no express", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd", 2, 0.85, "governed by a bsd|use of this source", "(?:use of this source code is )?governed by a bsd style license that can be found in the license file"),
    ("apache-2", 1, 0.98, "licensed under the apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 1, 0.95, "apache org|www apache", "(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", 1, 0.95, "terms and conditions for use", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-2", 2, 0.85, "unless required by", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", 2, 0.85, "licensed to the apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 2, 0.85, "each contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-1.1", 1, 0.95, "this product includes", "this product includes software developed by the apache software foundation"),
    ("apache-2", 2, 0.9, "apache2|asl2|apache v2|asl 2|al2 0", "(?:apache2|asl2|apache v2|asl 2 0|al2 0)(?: licensed?| license)?"),
    ("zlib", 1, 0.95, "this software is provided", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", 2, 0.9, "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 2, 0.9, "origin of this software", "origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", 1, 0.95, "libpng", "libpng versions? [0-9]+(?: [0-9]+)* (?:through [0-9 ]+ )?(?:are|is) copyright"),
    ("boost", 1, 0.98, "boost software", "boost software license version 1 0 august 17th 2003"),
    ("boost", 1, 0.95, "permission is|permission to use", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", 2, 0.9, "distributed under the boost|boost org|www boost", "(?:distributed under the boost software license version 1 0|(?:www )?boost org license 1 0 txt)"),
    ("unlicense", 1, 0.98, "this is free", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 1, 0.9, "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("unlicense", 2, 0.9, "unlicense org|http unlicense|https unlicense", "(?:https? )?unlicense org"),
    ("wtfpl", 1, 0.97, "you just", "you just do what the f[a-z]* you want to"),
    ("beerware", 1, 0.95, "beerware|beer ware|the beer", "(?:the )?beer ?ware license|beerware license revision 42"),
    ("beerware", 1, 0.95, "if we meet", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("postgresql", 1, 0.95, "permission is|permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", 1, 0.9, "permission is|permission to use", "permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted(?: without fee)? provided that"),
    ("ncsa", 1, 0.95, "university of illinois|ncsa open", f"university of illinois ncsa open source {LIC}|ncsa open source {LIC}"),
    ("x11", 1, 0.9, "except as contained", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("curl", 1, 0.9, "except as contained", "except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("openssl", 1, 0.95, "this product includes", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 1, 0.95, "this product includes", "this product includes cryptographic software written by eric young"),
    ("python", 1, 0.95, "python", "python software foundation license version 2|psf license agreement for python"),
    ("python", 2, 0.9, "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    ("php", 1, 0.95, "this product includes", "this product includes php software freely available from"),
    ("ruby", 1, 0.9, "you may make", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("tcl", 1, 0.9, "authors hereby", "authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("unicode", 1, 0.95, "unicode", f"unicode inc {LIC} agreement data files and software|unicode {LIC} v3"),
    ("upl-1.0", 1, 0.95, "universal perm|upl 1", f"universal permissive {LIC}(?: v(?:ersion)? ?1 0)?|upl 1 0"),
    ("afl-3.0", 1, 0.95, "academic free|afl 3", f"academic free {LIC}(?: version| v)? ?3(?: 0)?|afl 3 0"),
    ("artistic", 1, 0.9, "intent of this", "intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic", 1, 0.9, "everyone is permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms under which a given free software package"),
    ("ftl", 1, 0.95, "freetype|portions", f"freetype project {LIC}|portions of this software are copyright {SOME}the freetype project"),
    ("ijg", 1, 0.95, "this software is based", "this software is based in part on the work of the independent jpeg group"),
    ("mulan-psl-2.0", 1, 0.97, "mulan|mulanpsl", "mulan ?psl(?: v2| 2 0)?|mulan permissive software license"),
    ("json", 1, 0.97, "software shall", "software shall be used for good not evil"),
    ("blueoak", 1, 0.95, "blue oak", f"blue oak model {LIC}"),
    ("vim", 1, 0.9, "vim lic", f"vim {LIC}"),
    ("public-domain", 1, 0.9, "author disclaim|authors disclaim|author hereby|authors hereby|author dedicate|authors dedicate|copyright holder", "(?:authors?|copyright holders?) (?:hereby )?(?:disclaims? copyright to this source code|dedicates? (?:any and all copyright interest in )?this (?:work|software) to the public domain)"),
    ("public-domain", 2, 0.85, "this work is|this work has|this file is|this file has|this software is|this software has|this code is|this code has|no copyright is", "this (?:work|file|software|code) (?:is|has been) (?:placed |released )?(?:in|into|to) the public domain|no copyright is claimed"),
    ("us-government", 1, 0.9, "this software|work of", "(?:this software is a )?work of the united states government|this software was developed by employees of the (?:national institute of standards|federal government)"),
    # copyleft
    ("gpl", 1, 0.95, "this program is free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", 1, 0.95, "is free software", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", 1, 0.95, "either version 2", "either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3.0", 1, 0.95, "either version 3", "either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2.0", 1, 0.97, "gnu general public|gnu lesser|gnu library|gnu affero", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", 1, 0.97, "gnu general public|gnu lesser|gnu library|gnu affero", "gnu general public license version 3 29 june 2007"),
    ("gpl-1.0", 1, 0.97, "gnu general public|gnu lesser|gnu library|gnu affero", "gnu general public license version 1 february 1989"),
    ("gpl", 1, 0.9, "licenses for most", "licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 1, 0.9, "gnu general public|gnu lesser|gnu library|gnu affero", "gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", 2, 0.85, "you should", "you should have received a copy of the gnu general public license along with"),
    ("gpl", 3, 0.75, "this program is distributed", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-2.0", 2, 0.9, "gplv2|gpl2|gpl", "gpl ?v? ?2(?: 0)?(?: only|plus| or later)?"),
    ("gpl-3.0", 2, 0.9, "gplv3|gpl3|gpl", "gpl ?v? ?3(?: 0)?(?: only|plus| or later)?"),
    ("gpl-2.0-classpath", 1, 0.95, "classpath|as a special", "classpath exception(?: 2 0)?|as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("lgpl", 1, 0.95, "this library is free", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", 1, 0.97, "gnu general public|gnu lesser|gnu library|gnu affero", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.0", 1, 0.97, "gnu general public|gnu lesser|gnu library|gnu affero", "gnu library general public license version 2 june 1991"),
    ("lgpl-3.0", 1, 0.97, "gnu general public|gnu lesser|gnu library|gnu affero", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl", 2, 0.85, "you should", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl-2.1", 2, 0.9, "lgpl", "lgpl ?v? ?2 1(?: only|plus| or later)?"),
    ("lgpl-3.0", 2, 0.9, "lgpl", "lgpl ?v? ?3(?: 0)?(?: only|plus| or later)?"),
    ("lgpl-2.1", 1, 0.95, "either version 2", "either version 2 1 of the license or (?:at your option )?any later version"),
    ("agpl-3.0", 1, 0.97, "gnu general public|gnu lesser|gnu library|gnu affero", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", 1, 0.95, "under the terms", "under the terms of the gnu affero general public license"),
    ("agpl-3.0", 2, 0.9, "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("agpl-3.0", 2, 0.9, "agpl", "agpl ?v? ?3(?: 0)?(?: only|plus| or later)?"),
    ("gfdl", 1, 0.95, "permission is|permission to use", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 2, 0.9, "with no invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 1, 0.97, "this source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 1, 0.95, "if a copy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", 2, 0.9, "mozilla org|http mozilla|https mozilla|http www moz|https www moz|www mozilla", "(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", 1, 0.97, "contents of this file", "contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", 1, 0.97, "this program and", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 1, 0.97, "this program and", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl", 1, 0.95, "accompanying program", "accompanying program is provided under the terms of this eclipse public license"),
    ("cddl", 1, 0.95, "contents of this file", "contents of this file are subject to the terms of (?:the|either) (?:the )?common development and distribution license"),
    ("cpl", 1, 0.95, "accompanying program", "accompanying program is provided under the terms of this common public license"),
    ("eupl", 1, 0.95, "licensed under the eupl|licenced under the eupl|eupl", "licen[sc]ed under the eupl(?: version| v)?(?: 1 [012])?|eupl v ?1 [012]"),
    ("osl", 1, 0.95, "licensed under the open", "licensed under the open software license version [123] [01]"),
    ("ms-pl", 1, 0.95, "this license governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("qpl", 1, 0.95, "q public|qpl", f"q public {LIC}(?: version 1 0)?|qpl 1 0"),
    ("sleepycat", 1, 0.95, "sleepycat", f"sleepycat {LIC}"),
    ("cecill", 1, 0.95, "cecill", "cecill(?: b| c)?(?: free software license agreement| licence| license| v?2 1)"),
    ("ofl", 1, 0.97, "this font software", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", 2, 0.9, "scripts sil|http scripts|https scripts", "(?:https? )?scripts sil org ofl"),
    # data, text and media
    ("cc0", 1, 0.97, "to the extent", "to the extent possible under law (?:the )?(?:author|person|affirmer|copyright holder|[^ ]+ [^ ]+)s? (?:who associated cc0 with this work )?has waived all copyright and related or neighboring rights"),
    ("cc0", 1, 0.95, "creativecommons|creative", "creative ?commons org publicdomain zero 1 0"),
    ("cc-by", 1, 0.97, "creativecommons|creative", "creative ?commons org licen[sc]es by [1-4] [05]"),
    ("cc-by-sa", 1, 0.97, "creativecommons|creative", "creative ?commons org licen[sc]es by sa [1-4] [05]"),
    ("cc-by-nc", 1, 0.97, "creativecommons|creative", "creative ?commons org licen[sc]es by nc [1-4] [05]"),
    ("cc-by-nd", 1, 0.97, "creativecommons|creative", "creative ?commons org licen[sc]es by nd [1-4] [05]"),
    ("cc-by-nc-sa", 1, 0.97, "creativecommons|creative", "creative ?commons org licen[sc]es by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 1, 0.97, "creativecommons|creative", "creative ?commons org licen[sc]es by nc nd [1-4] [05]"),
    ("cc", 3, 0.8, "this work is|this article is|this content is|except where otherwise", "(?:this (?:work|article|content) is|except where otherwise noted content on this site is) licensed under a creative commons"),
    ("cc", 3, 0.7, "some rights", "some rights reserved"),
    ("cc-by-sa", 1, 0.9, "text is available", f"text is available under the creative commons attribution share ?alike {LIC}"),
    ("cc-by", 2, 0.85, "this is an open", "this is an open access article distributed under the (?:terms of the )?creative commons attribution(?: license)?"),
    ("odbl", 1, 0.95, "made available|this database", "(?:made available|this database is licensed) under the open database license"),
    ("odbl", 2, 0.85, "openstreetmap", "openstreetmap contributors(?: under odbl)?"),
    ("odc-by", 1, 0.95, "made available", "made available under the open data commons attribution license"),
    ("open-government", 1, 0.95, "contains public sector", "contains public sector information licensed under the open government licence"),
    ("etalab", 1, 0.95, "licence ouverte|etalab", "licence ouverte(?: open licence)?(?: version)?(?: 2 0)?|etalab 2 0"),
    ("dl-de", 1, 0.95, "datenlizenz", "datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: 2 0)?"),
    # restricted and proprietary
    ("sspl", 1, 0.95, "server side|sspl", "server side public license version 1|sspl ?v1"),
    ("elastic", 1, 0.95, "you may not provide", "you may not provide the software to third parties as a hosted or managed service"),
    ("bsl", 1, 0.95, "licensor|additional", "licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work|additional use grant"),
    ("commons-clause", 1, 0.97, "commons|software is provided to you", "commons clause license condition v1 0|software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("polyform", 1, 0.97, "polyform", f"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) {LIC}"),
    ("prosperity", 1, 0.95, "prosperity", f"prosperity public {LIC}"),
    ("fsl", 1, 0.95, "functional source", f"functional source {LIC}"),
    ("openrail", 1, 0.95, "use based res", "use based restrictions as referenced in paragraph 5"),
    ("llama", 1, 0.95, "llama", "llama ?[0-9]*(?: [0-9]+)? community license(?: agreement)?"),
    ("gemma", 1, 0.95, "gemma", "gemma (?:is provided under and subject to the gemma )?terms of use"),
    ("proprietary", 1, 0.9, "unauthorized|unauthorised", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or distribution)? of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited"),
    ("proprietary", 1, 0.9, "confidential|this software is", "confidential and proprietary(?: information)? of|this software is (?:the )?(?:confidential and )?proprietary (?:information )?(?:of|to)"),
    ("proprietary", 2, 0.8, "no part", "no part of this (?:publication|book|document|work) may be reproduced (?:stored|distributed|or transmitted|copied)"),
    ("proprietary", 2, 0.8, "may not be", "may not be (?:reproduced|copied|redistributed)(?: or (?:distributed|redistributed))? without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    ("proprietary", 2, 0.8, "for internal|for personal", "for (?:internal|personal non commercial) use only"),
    ("evaluation", 1, 0.85, "for evaluation", "for evaluation purposes only"),
    ("non-commercial", 2, 0.8, "for non|for noncommercial|for academic|for research|non commercial", "for (?:non ?commercial|academic|research)(?: and (?:academic|research|educational|non ?commercial))? (?:use|purposes) only|non commercial use only"),
    ("eula", 1, 0.9, "end user", f"end user {LIC} agreement"),
    ("all-rights-reserved", 2, 0.8, "tutti", "tutti i diritti (?:sono )?riservati"),
    ("all-rights-reserved", 2, 0.8, "todos", "todos os direitos reservados"),
    ("all-rights-reserved", 2, 0.8, "alle rechten", "alle rechten voorbehouden"),
    ("all-rights-reserved", 2, 0.8, "med ensamrätt|alla", "alla rättigheter (?:är )?(?:förbehållna|reserverade)"),
    ("all-rights-reserved", 2, 0.8, "wszelkie|wszystkie", "(?:wszelkie|wszystkie) prawa zastrzeżone"),
    ("all-rights-reserved", 2, 0.8, "все|Все", "[Вв]се права защищены"),
]
