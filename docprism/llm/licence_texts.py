"""Paragraphs from which the licence classifier learns: public licence wording by family, and sentences of no family."""

from __future__ import annotations

#: Notices and paragraphs by family.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0 or later", "released under the agplv3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu affero general public license along with this program",
        "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source of your version",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2.0", "apache license version 2.0 january 2004", "spdx license identifier apache 2.0", "distributed under the apache 2.0 license",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work",
    ],
    "boost": [
        "distributed under the boost software license version 1.0", "spdx license identifier bsl 1.0", "boost software license version 1.0 august 17th 2003",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    ],
    "bsd": [
        "licensed under the bsd 3 clause license", "released under the bsd license", "spdx license identifier bsd 2 clause", "use of this source code is governed by a bsd style license that can be found in the license file",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "cc-by": [
        "licensed under cc by 4.0", "creative commons attribution 4.0 international license", "licensed under a creative commons attribution license", "spdx license identifier cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license to view a copy of this license visit",
        "you must give appropriate credit provide a link to the license and indicate if changes were made",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license", "licensed under a creative commons attribution noncommercial license", "licensed under cc by nc sa 4.0", "licensed under cc by nc nd 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "you may not use the material for commercial purposes",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4.0", "creative commons attribution sharealike 4.0 international license", "licensed under a creative commons attribution sharealike license", "spdx license identifier cc by sa 4.0",
        "text is available under the creative commons attribution sharealike license additional terms may apply",
        "if you remix transform or build upon the material you must distribute your contributions under the same license as the original",
    ],
    "cc0": [
        "cc0 1.0 universal public domain dedication", "spdx license identifier cc0 1.0", "released under cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
    "epl": [
        "licensed under the eclipse public license version 2.0", "spdx license identifier epl 2.0", "eclipse public license v 2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at",
        "any use reproduction or distribution of the program constitutes recipient's acceptance of this agreement",
    ],
    "eupl": [
        "licensed under the eupl version 1.2 or later", "european union public licence v 1.2", "spdx license identifier eupl 1.2",
        "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence",
        "you may not use this work except in compliance with the licence you may obtain a copy of the licence at",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3", "licensed under the gpl version 2 or later", "spdx license identifier gpl 3.0 or later", "spdx license identifier gpl 2.0 only", "gnu general public license version 2 june 1991", "released under the gplv3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see",
        "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software",
    ],
    "isc": [
        "licensed under the isc license", "spdx license identifier isc", "isc license isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ],
    "lgpl": [
        "gnu lesser general public license version 2.1", "licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 2.1 or later", "released under the lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "this library is distributed in the hope that it will be useful but without any warranty see the gnu lesser general public license for more details",
    ],
    "mit": [
        "released under the mit license", "licensed under the mit license", "the mit license mit", "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "mpl-2.0": [
        "licensed under the mpl 2.0 license", "spdx license identifier mpl 2.0", "mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights other than patent or trademark licensable by such contributor",
    ],
    "proprietary": [
        "all rights reserved", "copyright all rights reserved no part may be reproduced", "unauthorized copying of this file is strictly prohibited",
        "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
        "this software is the confidential and proprietary information of the company you shall not disclose such confidential information",
        "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",
    ],
    "unlicense": [
        "released under the unlicense", "spdx license identifier unlicense",
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    ],
}

#: Sentences of no family: who, does what, with what.
_WHO = ("the driver", "a museum", "the city council", "her brother", "the new owner", "a small company", "the ministry", "our teacher", "the public library", "a young engineer")
_DOES = (
    "needs a valid license to", "asked for permission to", "was granted a license by the office to", "renewed the fishing license in spring to", "reserved all seats to", "used free software to", "paid the license fee to",
    "read about copyright law before they could", "found a license plate near the road and went to", "signed the terms of the agreement to", "made no warranty claim when told to", "may copy the notes in order to",
)
_WHAT = ("operate the crane", "use the hall on weekends", "distribute leaflets in the park", "sell copies of the map", "modify the old house", "publish the annual report", "open the building to any person", "provide meals free of charge")
#: Plain sentences with words of the trade.
_PLAIN = (
    "copyright law protects authors of original works", "poetic license is common in such verse", "the software can be downloaded from the site", "the version of the story told here is the third",
    "general conditions of the market improved", "this license expired last year", "a commercial license costs more than a private one", "the foundation published its report",
    "his work is free of charge on weekends", "the source of the river lies in the north", "the notice above the door is new", "the following conditions were met by the players",
    "software engineers met in berlin", "creative people work in common rooms", "the warranty on the car has expired", "permission to enter the building is required",
    "the museum asked permission to copy the painting", "the office grants a license within ten days", "the driver must hold a valid license to operate this vehicle", "all seats are reserved for members",
)


def other_sentences() -> list[str]:
    return [*_PLAIN, *(f"{who} {does} {what}" for k, who in enumerate(_WHO) for j, does in enumerate(_DOES) for i, what in enumerate(_WHAT) if (k + j + i) % 3 == 0)]
