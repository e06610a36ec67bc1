"""Templates of licences by SPDX id: short statements, standard headers and whole texts. Their wording is fixed by the licences."""

from __future__ import annotations

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""

_GNU = """This {work} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.
This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {work}{tail}"""
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."


def _gnu(name: str, version: str, work: str = "program", old: bool = False) -> str:
    return _GNU.format(work=work, name=name, version=version, colon=";" if old else ":", comma=";" if old else ",", tail=_WRITE if old else _SEE)


_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_OPEN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_0BSD_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""

_GPL_TEXT = """GNU GENERAL PUBLIC LICENSE Version {version}
Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""

#: Names of licences as statements give them; each is looked for in the wordings below.
_NAMES = {
    "MIT": "MIT License", "Apache-2.0": "Apache License 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
    "GPL-2.0": "GNU General Public License v2.0", "GPL-3.0": "GNU General Public License v3.0", "LGPL-2.1": "GNU Lesser General Public License v2.1",
    "LGPL-3.0": "GNU Lesser General Public License v3.0", "AGPL-3.0": "GNU Affero General Public License v3.0", "MPL-1.1": "Mozilla Public License 1.1",
    "MPL-2.0": "Mozilla Public License 2.0", "EPL-1.0": "Eclipse Public License 1.0", "EPL-2.0": "Eclipse Public License 2.0", "EUPL-1.2": "European Union Public Licence 1.2",
    "CDDL-1.0": "Common Development and Distribution License 1.0", "Artistic-2.0": "Artistic License 2.0", "AFL-3.0": "Academic Free License 3.0", "OFL-1.1": "SIL Open Font License 1.1",
    "MS-PL": "Microsoft Public License", "PostgreSQL": "PostgreSQL License", "NCSA": "University of Illinois NCSA Open Source License", "BSL-1.0": "Boost Software License 1.0",
    "Zlib": "zlib License", "ISC": "ISC License", "Unlicense": "Unlicense", "WTFPL": "WTFPL", "0BSD": "Zero-Clause BSD License", "CC0-1.0": "CC0 1.0 Universal",
}
_WORDINGS = ("Licensed under the {}.", "This project is licensed under the terms of the {}.")

#: (SPDX id, kind, text). A statement names a licence, a header stands in source files, a text is (the opening of) a licence file.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "statement", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "statement", "Released under the MIT License."),
    ("GPL-3.0", "statement", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "statement", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "statement", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "statement", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "statement", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "statement", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "statement", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "statement", "Licensed under the BSD 2-Clause License."),
    ("ISC", "statement", "Licensed under the ISC License."),
    ("EPL-2.0", "statement", "Licensed under the Eclipse Public License, version 2.0."),
    ("CC-BY-NC-4.0", "statement", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "statement", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "statement", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "statement", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "statement", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "statement", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "statement", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Apache-2.0", "header", _APACHE),
    ("GPL-3.0", "header", _gnu("General Public License", "3")),
    ("GPL-2.0", "header", _gnu("General Public License", "2", old=True)),
    ("LGPL-3.0", "header", _gnu("Lesser General Public License", "3", "library")),
    ("LGPL-2.1", "header", _gnu("Lesser General Public License", "2.1", "library", old=True)),
    ("AGPL-3.0", "header", _gnu("Affero General Public License", "3")),
    ("MPL-2.0", "header", _MPL),
    ("EPL-2.0", "header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-3-Clause", "header", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "text", "\n".join((_MIT_GRANT, _MIT_NOTICE, _MIT_DISCLAIMER))),
    ("MIT", "text", _MIT_GRANT),
    ("BSD-2-Clause", "text", "\n".join((_BSD_OPEN, _BSD_DISCLAIMER))),
    ("BSD-3-Clause", "text", "\n".join((_BSD_OPEN, _BSD_NAMES, _BSD_DISCLAIMER))),
    ("ISC", "text", "\n".join((_ISC_GRANT, _ISC_DISCLAIMER))),
    ("0BSD", "text", "\n".join((_0BSD_GRANT, _ISC_DISCLAIMER))),
    ("Unlicense", "text", "\n".join((_UNLICENSE, _MIT_DISCLAIMER))),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "text", _ZLIB),
    ("BSL-1.0", "text", "\n".join((_BOOST, _MIT_DISCLAIMER))),
    ("Apache-2.0", "text", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "text", _GPL_TEXT.format(version="3, 29 June 2007")),
    ("GPL-2.0", "text", _GPL_TEXT.format(version="2, June 1991")),
    ("LGPL-3.0", "text", _GPL_TEXT.format(version="3, 29 June 2007").replace("GENERAL", "LESSER GENERAL")),
    ("AGPL-3.0", "text", _GPL_TEXT.format(version="3, 19 November 2007").replace("GENERAL", "AFFERO GENERAL")),
    ("MPL-2.0", "text", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "text", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
) + tuple((spdx, "statement", wording.format(name)) for spdx, name in _NAMES.items() for wording in _WORDINGS)
