"""What the licence classifier learns from: names, notices and passages of licences, and texts that are none (fixed values)."""

from __future__ import annotations

CC_PARTS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}


def _creative_commons(kind: str) -> list[str]:
    short, long = f"BY{kind}", "-".join(CC_PARTS[x] for x in f"BY{kind}".split("-"))
    names = [f"CC {short}", f"CC-{short}", f"CC-{short}-4.0", *(f"CC {short} {v}" for v in ("2.0", "3.0", "4.0"))]
    return names + [f"Creative Commons {long}{x}" for x in ("", " License", " 4.0", " 4.0 International License", " 3.0 Unported License")]


#: What each family is called.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT", "Expat License", "X11 License", "MIT/X11 license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License", "Apache license", "ASL 2.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD 2-Clause License", "BSD-2-Clause", "New BSD License", "3-clause BSD license"],
    "ISC": ["ISC License", "ISC licence", "ISC"],
    "zlib": ["zlib License", "zlib/libpng license"],
    "GPL": [
        "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License", "GNU GPL", "GNU GPL version 3",
        "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0-or-later", "GPL", "GPL version 2 or later",
    ],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPL-2.1", "LGPLv3"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL", "AGPL-3.0", "AGPLv3"],
    "GFDL": ["GNU Free Documentation License", "GNU Free Documentation License, Version 1.3", "GNU FDL", "GFDL", "GFDL-1.3"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0", "MPL"],
    "EPL": ["Eclipse Public License", "Eclipse Public License v2.0", "EPL-2.0", "EPL 1.0", "EPL"],
    "EUPL": ["European Union Public Licence", "European Union Public Licence 1.2", "EUPL", "EUPL-1.2", "EUPL v1.2"],
    "BSL-1.0": ["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0", "Boost license"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "CC0": ["CC0", "CC0 1.0", "Creative Commons Zero", "CC0 1.0 Universal", "Creative Commons CC0 public domain dedication"],
    "CC-BY": _creative_commons(""),
    "CC-BY-SA": _creative_commons("-SA"),
    "CC-BY-NC": _creative_commons("-NC"),
    "CC-BY-ND": _creative_commons("-ND"),
    "CC-BY-NC-SA": _creative_commons("-NC-SA"),
    "CC-BY-NC-ND": _creative_commons("-NC-ND"),
}

#: What a notice says around a name: those learnt from, and others that calibrate.
FORMS = [
    "Licensed under {}.",
    "Licensed under the {}.",
    "Licensed under the terms of the {}.",
    "Released under the {}.",
    "Released under {} by its authors.",
    "This work is licensed under the {}.",
    "This work is licensed under a {} license.",
    "This project is licensed under the {} - see the LICENSE file for details.",
    "This software is distributed under the terms of the {}.",
    "This program is free software under the {}.",
    "Published under {}.",
    "Available under the {}.",
    "It is made available under the terms of the {}.",
    "You may use this under the terms of the {}.",
    "You can redistribute it under the {}.",
    "Content is available under {} unless otherwise noted.",
    "SPDX-License-Identifier: {}",
    "License: {}",
    "The code is covered by the {}; see the LICENSE file.",
    "Copyright 2019 the authors. Licensed under the {}.",
    "All files are subject to the {}.",
    "Text is provided under {}.",
    "Lizenziert unter {}.",
    "Veröffentlicht unter der {}.",
    "Sous licence {}.",
    "Distribué sous licence {}.",
    "Bajo licencia {}.",
    "Publicado bajo la licencia {}.",
]
CALIBRATING = [
    "This library is released under the terms of the {}.",
    "Distributed under {}.",
    "The documentation is licensed under {} and may be shared.",
    "Source code is available under a {} license.",
    "Its license is the {}.",
    "Dieses Werk ist lizenziert unter der {}.",
    "Ce texte est publié sous licence {}.",
    "Esta obra está bajo una licencia {}.",
]
#: Notices of two licences.
DUAL = ["Dual licensed under {} or {}.", "Licensed under either of {} or {} at your option.", "This is available under both the {} and the {}.", "License: {} OR {}"]

_FREE = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the {} for more details.",
    "You should have received a copy of the {} along with this program. If not, see the licenses at gnu org.",
]
_SHARE = "You are free to share, copy and redistribute the material in any medium or format"
_CREDIT = "You must give appropriate credit, provide a link to the license, and indicate if changes were made."
_ALIKE = "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."
_NO_TRADE = "You may not use the material for commercial purposes."
_AS_IT_IS = "If you remix, transform, or build upon the material, you may not distribute the modified material."

#: Passages of the licences' own texts, and notices without a name.
PASSAGES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such",
    ],
    "GPL": [x.format("GNU General Public License") for x in _FREE],
    "LGPL": [x.format("GNU Lesser General Public License") for x in _FREE],
    "AGPL": [x.format("GNU Affero General Public License") for x in _FREE],
    "GFDL": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled GNU Free Documentation License."
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla org MPL 2.0"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at eclipse org legal epl-2.0"],
    "EUPL": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0 or copy at boost org",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
    "CC-BY": [f"{_SHARE}, and to adapt it for any purpose, even commercially. {_CREDIT}"],
    "CC-BY-SA": [f"{_SHARE}, and to adapt it for any purpose, even commercially. {_CREDIT} {_ALIKE}"],
    "CC-BY-NC": [f"{_SHARE} and to adapt it. {_CREDIT} {_NO_TRADE}"],
    "CC-BY-NC-SA": [f"{_SHARE} and to adapt it. {_CREDIT} {_NO_TRADE} {_ALIKE}"],
    "CC-BY-NC-ND": [f"{_SHARE}. {_CREDIT} {_NO_TRADE} {_AS_IT_IS}"],
    "public domain": [
        "This work is dedicated to the public domain.",
        "This work is in the public domain.",
        "This image is in the public domain because its copyright has expired.",
        "Released into the public domain by its author.",
        "Public domain, no rights reserved.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2021 the company. All rights reserved.",
        "Copyright by the author, all rights reserved worldwide.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "No part of this book may be copied, stored or transmitted in any form without permission in writing.",
        "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
        "This material may not be published, broadcast, rewritten or redistributed without permission.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
        "Reproduction interdite sans autorisation écrite de l'éditeur.",
        "Nachdruck nur mit schriftlicher Genehmigung des Verlags.",
    ],
}

#: A family's name where nothing is licensed.
TALK = [
    "The {} was discussed at the meeting.",
    "The {} was discussed by students who wrote nothing.",
    "He gave a talk on the history of the {}.",
    "Many people have heard of {} and few have read it.",
    "She compared {} with {} in her thesis.",
    "The article about {} was long.",
    "Students at {} built a small robot.",
    "What is the {}, and who wrote it?",
    "Lawyers disagree about {}.",
    "In 2007 the {} was revised after a long debate.",
    "Choosing between {} and {} is hard.",
    "We do not use {} here.",
    "A professor from {} spoke about rivers.",
    "The foundation behind {} moved to another city.",
]

#: Words of notices in other company.
OTHER = [
    "He lost his driver license in March and drove on without one.",
    "The license plate was found near the river.",
    "She reserved a table for two, and all was well.",
    "Rooms must be reserved in advance, and all guests pay on arrival.",
    "The Apache helicopter landed at noon.",
    "Researchers at MIT built a small robot.",
    "The gnu is an antelope of the plains.",
    "The creative team met on the commons near the village.",
    "The domain of the function is the whole plane.",
    "The domain name expired last year and the public was told.",
    "Copyright law was debated in parliament, and the rights of authors were much discussed.",
    "The clause in the contract says nothing of that.",
    "Permission to land was refused by the tower.",
    "The permission slip must be signed by a parent.",
    "The redistribution of wealth is an old theme in politics.",
    "A fishing licence costs ten crowns and is valid for a year.",
    "The pub was licensed to sell beer in 1890.",
    "The hotel is licensed under the old act of 1872 and open all year.",
    "The attribution of the painting is disputed among scholars.",
    "The warranty covers parts for two years from the date of purchase.",
    "The warranty on this car is limited to a particular purpose of use.",
    "Mozilla was a lizard in the old logo.",
    "The rights of the child were discussed at the general assembly.",
    "Reservation of rights and duties in the treaty of the union.",
    "General public opinion was divided over the new version.",
    "License fees rose again this year, and the public complained.",
    "The CC line of the mail held three names, by order of the chair.",
    "Version 3 of the plan was released under pressure from the public.",
    "The driver was released under bail in the afternoon.",
    "The software was distributed to all schools without charge.",
    "You may use the kitchen in the evening if you clean it.",
    "The terms of the agreement were published in the newspaper.",
    "The report is available in all libraries and was published under her maiden name.",
    "The eclipse was seen by the public in all of the union.",
    "A boost in software sales was noted in version 1.0 of the report.",
    "The European Union issued a public tender for the bridge.",
    "The work is in the basement of the museum.",
    "This work is a study of public life in the old domain of the counts.",
    "The library is open to the general public on all days.",
    "La licencia de conducir es necesaria.",
    "La licence de pêche est chère.",
    "Il a obtenu sa licence de droit à Lyon.",
    "Die Lizenz zum Töten ist ein Film.",
    "Unter der Brücke lag ein Boot, und alle Rechte der Fischer waren alt.",
    "Er fuhr mit der Bahn in die Stadt und kam mit dem Bus zurück.",
    "Mit der Zeit wurde es besser, und sie sprach mit allen.",
    "Ich gehe mit meinem Bruder unter die Leute.",
]
