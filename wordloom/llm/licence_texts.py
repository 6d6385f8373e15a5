"""Known licences: fixed values (public licence texts and notices)."""

_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so{0}

"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE.
"""
_MIT_NOTICE = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted{0}."""
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
_BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and
to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.
3. This notice may not be removed or altered from any source distribution.
"""

# (licence id, text): entire licences, with and without their title, and notices that name a licence
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_GRANT.format(_MIT_NOTICE) + _AS_IS),
    ("MIT", "MIT License\n" + _MIT_GRANT.format(_MIT_NOTICE) + _AS_IS),
    ("MIT", "The MIT License (MIT)\n" + _MIT_GRANT.format(_MIT_NOTICE) + _AS_IS),
    ("MIT-0", _MIT_GRANT.format(".") + _AS_IS),
    ("MIT-0", "MIT No Attribution\n" + _MIT_GRANT.format(".") + _AS_IS),
    ("ISC", _ISC_GRANT.format(_ISC_NOTICE) + _ISC_AS_IS),
    ("ISC", "ISC License\n" + _ISC_GRANT.format(_ISC_NOTICE) + _ISC_AS_IS),
    ("0BSD", _ISC_GRANT.format("") + _ISC_AS_IS),
    ("0BSD", "Zero-Clause BSD\n" + _ISC_GRANT.format("") + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_GRANT + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_NAME + _BSD_AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_GRANT + _BSD_NAME + _BSD_AS_IS),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

# spelling -> canonical spelling, applied to lower-case text at the beginnings of words; those that end
# in a blank are whole words
EQUIVALENT: tuple[tuple[str, str], ...] = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasis", "emphasiz"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialis", "initializ"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximis", "maximiz"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimis", "optimiz"), ("organis", "organiz"), ("practise", "practice"), ("programme", "program"),
    ("realis", "realiz"), ("recognis", "recogniz"), ("signalling", "signaling"), ("utilis", "utiliz"),
    ("whilst", "while"), ("wilful", "willful"), ("per cent ", "percent "), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("and or ", "or "), ("https", "http"),
)
