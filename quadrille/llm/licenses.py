"""Licence phrases and notices that the scan looks for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """``words`` of a label; a ``share`` of their weight must stand in order, and every key phrase in full.  A share of 1 makes it a phrase."""

    label: str
    words: str
    keys: tuple[str, ...] = ()
    share: float = 0.8
    base: bool = False


# The base phrases and their labels.
BASE = (
    Template("mit", "mit license", share=1.0, base=True),
    Template("apache", "apache license", share=1.0, base=True),
    Template("gpl", "general public license", share=1.0, base=True),
)

# Short phrases that name a licence.
NAMES = (
    Template("apache-2.0", "apache license version 2 0", share=1.0),
    Template("gpl-3.0", "gnu general public license version 3", share=1.0),
    Template("gpl-2.0", "gnu general public license version 2", share=1.0),
    Template("lgpl", "gnu lesser general public license", share=1.0),
    Template("agpl", "gnu affero general public license", share=1.0),
    Template("cc-by", "creative commons attribution", share=1.0),
)

# Public licence texts and notices as their authors word them, each with the phrases that make it out.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
_MIT_REST = """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"
_APACHE_REST = """. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
_GNU_REST = """, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = """: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = "This is free and unencumbered software released into the public domain"
_UNLICENSE_REST = """. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"
_MPL_REST = ". If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce,
display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
_CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"

_DEAL = ("hereby granted free of charge", "deal in the software without restriction")
_FORMS = ("source and binary forms", "the following conditions are met")
NOTICES = (
    Template("mit", _MIT_GRANT, _DEAL),
    Template("mit", _MIT_GRANT + _MIT_REST, _DEAL),
    Template("apache", _APACHE_NOTICE, ("apache license version 2 0", "in compliance with the license")),
    Template("apache-2.0", _APACHE_NOTICE + _APACHE_REST, ("apache license version 2 0", "in compliance with the license")),
    Template("gpl", _GNU_GRANT, ("gnu general public license", "free software foundation")),
    Template("gpl-3.0", _GNU_GRANT + _GNU_REST, ("gnu general public license", "either version 3 of the license")),
    Template("gpl-2.0", _GNU_GRANT + _GNU_REST.replace("version 3", "version 2"), ("gnu general public license", "either version 2 of the license")),
    Template("lgpl", (_GNU_GRANT + _GNU_REST).replace("General Public", "Lesser General Public"), ("gnu lesser general public license", "free software foundation")),
    Template("agpl", (_GNU_GRANT + _GNU_REST).replace("General Public", "Affero General Public"), ("gnu affero general public license", "free software foundation")),
    Template("bsd", _BSD_OPENING, _FORMS),
    Template("bsd-2-clause", _BSD_OPENING + _BSD_TWO + _BSD_DISCLAIMER, (*_FORMS, "with the distribution this software is provided")),
    Template("bsd-3-clause", _BSD_OPENING + _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER, (*_FORMS, "endorse or promote products")),
    Template("isc", _ISC_GRANT, ("distribute this software for any purpose",)),
    Template("isc", _ISC_GRANT + _ISC_REST, ("distribute this software for any purpose", "the above copyright notice")),
    Template("0bsd", _ISC_GRANT + " " + _ISC_REST[_ISC_REST.index("THE SOFTWARE") :], ("hereby granted the software is provided",)),
    Template("zlib", _ZLIB, ("must not be misrepresented", "this notice may not be removed or altered")),
    Template("unlicense", _UNLICENSE, ("free and unencumbered software",)),
    Template("unlicense", _UNLICENSE + _UNLICENSE_REST, ("free and unencumbered software", "dedicate any and all copyright interest")),
    Template("mpl-2.0", _MPL, ("mozilla public license",)),
    Template("mpl-2.0", _MPL + _MPL_REST, ("mozilla public license", "distributed with this file")),
    Template("bsl-1.0", _BOOST, ("person or organization obtaining", "prepare derivative works")),
    Template("cc0", _CC0, ("neighboring rights",)),
)
TEMPLATES = BASE + NAMES + NOTICES
