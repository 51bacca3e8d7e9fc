"""Texts by which licences are recognised, paragraph by paragraph, each with the phrases one of which must stand whole."""

from __future__ import annotations

import re
from typing import NamedTuple


class Template(NamedTuple):
    label: str
    words: str
    #: One of them must stand whole where the alignment puts it.
    phrases: tuple[str, ...]


def words_of(text: str) -> str:
    """A text's words as a scan sees them, with a blank between."""
    return " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower()))


# Sentences, notices and whole texts of well-known licences.
_TEXTS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
        ("gnu affero general public license",),
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the License", ("except in compliance with the license",)),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        ("apache license", "www apache org licenses license 2 0"),
    ),
    (
        "apache-2.0",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        ("without warranties or conditions of any kind", "governing permissions and limitations under the license"),
    ),
    (
        "apache-2.0",
        """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to
        You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce,
        prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such
        Derivative Works in Source or Object form.""",
        ("grant of copyright license", "irrevocable copyright license"),
    ),
    (
        "apache-2.0",
        """Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a
        perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent
        license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work""",
        ("grant of patent license",),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        ("source and binary forms",),
    ),
    ("bsd", "Released under the BSD License", ("bsd license",)),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce"),
    ),
    (
        "bsd",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
        ("endorse or promote products derived from this software",),
    ),
    (
        "bsd",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ("procurement of substitute goods or services", "even if advised of the possibility of such damage"),
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so""",
        ("free of charge to any person or organization",),
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial",)),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International License", ("attribution noderivatives",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related rights",
        ("waived all copyright",),
    ),
    (
        "cc0",
        """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or
        her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent
        allowed by law.""",
        ("dedicated the work to the public domain",),
    ),
    (
        "epl-2.0",
        "made available under the terms of the Eclipse Public License 2.0",
        ("eclipse public license",),
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    (
        "gpl",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("gnu general public license",),
    ),
    (
        "gpl",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version.""",
        ("gnu general public license",),
    ),
    (
        "gpl",
        """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        ("gnu general public license",),
    ),
    (
        "gpl",
        """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU
        General Public License is intended to guarantee your freedom to share and change free software--to make sure the
        software is free for all its users.""",
        ("guarantee your freedom to share and change",),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted""",
        ("with or without fee",),
    ),
    (
        "isc",
        """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
        ("the author disclaims all warranties", "negligence or other tortious action"),
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version.""",
        ("gnu lesser general public license",),
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        ("free of charge to any person",),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions""",
        ("to deal in the software without restriction",),
    ),
    (
        "mit",
        """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
        ("copies or substantial portions of the software",),
    ),
    (
        "mit",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("the use or other dealings in the software", "for a particular purpose and noninfringement"),
    ),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("mozilla public license", "a copy of the mpl was not distributed"),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    (
        "unlicense",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
        or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("for any purpose commercial or non commercial",),
    ),
    (
        "unlicense",
        """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
        the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law.""",
        ("relinquishment in perpetuity", "detriment of our heirs and successors"),
    ),
    (
        "wtfpl",
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
        allowed as long as the name is changed.""",
        ("changing it is allowed as long as the name is changed",),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions""",
        ("to alter it and redistribute it freely",),
    ),
    (
        "zlib",
        """The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
        you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
        required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. This notice may not be removed or altered from any source distribution.""",
        ("must be plainly marked as such", "must not be misrepresented"),
    ),
)
TEMPLATES = tuple(Template(label, words_of(text), phrases) for label, text, phrases in _TEXTS)
# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
