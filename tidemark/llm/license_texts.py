"""The words of short public licences, by SPDX identifier, and the titles that stand above them."""

from __future__ import annotations

import re
import textwrap

#: Widths of lines at which texts are wrapped.
WIDTHS = tuple(range(68, 82))

_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
{holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAME = "Neither the name of {the}copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = ("COPYRIGHT HOLDER", "COPYRIGHT OWNER")
_GRANT = "Permission to use, copy, modify, {and_or} distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND {who} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {who} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_UNLICENSE_MORE = "\n\nFor more information, please refer to <{url}>"
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies
or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING
THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _clauses(*clauses: str) -> list[str]:
    """The clauses with a number, a star or nothing before each."""
    return ["\n\n".join(clauses), "\n\n".join(f"{i}. {c}" for i, c in enumerate(clauses, 1))]


def _unwrapped(text: str) -> str:
    """One line a paragraph, so that no line begins with a word that marks a copyright line."""
    return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))


def _wrapped(texts: list[str]) -> list[str]:
    """The texts unwrapped, and as lines of each usual width where a line then begins with the word "copyright": canonical text lacks such lines."""
    out = {t: t for t in map(_unwrapped, texts)}
    for t in list(out):
        for width in WIDTHS:
            lines = [line for p in t.split("\n\n") for line in textwrap.wrap(p, width)]
            out.setdefault(" ".join(x for x in lines if not re.match(r"\W*copyright", x, re.I)), "\n".join(lines))
    return list({" ".join(k.split()): t for k, t in reversed(out.items())}.values())


def _titled(name: str, titles: list[str], bodies: list[str]) -> list[tuple[str, str]]:
    return [(name, f"{title}\n\n{body}" if title else body) for body in _wrapped(bodies) for title in ["", *titles]]


def short_texts() -> list[tuple[str, str]]:
    """(SPDX identifier, text): each short licence under each of its titles, in its usual wordings. Copyright lines are not part of a text."""
    two = [f"{_BSD}\n\n{c}\n\n{_WARRANTY.format(holder=h)}" for c in _clauses(_SOURCE, _BINARY) for h in _HOLDERS]
    three = [f"{_BSD}\n\n{c}\n\n{_WARRANTY.format(holder=h)}" for the in ("the ", "") for c in _clauses(_SOURCE, _BINARY, _NAME.format(the=the)) for h in _HOLDERS]
    grant = [_GRANT.format(and_or=x) for x in ("and/or", "and")]
    isc = [f"{g}{_ISC_NOTICE}\n\n{_ISC_WARRANTY.format(who=who)}" for g in grant for who in ("THE AUTHOR", "ISC")]
    zero = [f"{g}.\n\n{_ISC_WARRANTY.format(who='THE AUTHOR')}" for g in grant]
    free = [_UNLICENSE + more for more in ("", *(_UNLICENSE_MORE.format(url=u) for u in ("https://unlicense.org", "http://unlicense.org/")))]
    return [
        *_titled("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "(The MIT License)", "The MIT License\n\nMIT License"], [_MIT]),
        *_titled("BSD-2-Clause", ["BSD License", "The BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'], two),
        *_titled("BSD-3-Clause", ["BSD License", "The BSD License", "New BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'], three),
        *_titled("ISC", ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"], isc),
        *_titled("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"], zero),
        *_titled("Zlib", ["zlib License", "The zlib License"], [_ZLIB]),
        *_titled("Unlicense", ["The Unlicense"], free),
        *_titled("BSL-1.0", [], [_BSL]),
    ]
