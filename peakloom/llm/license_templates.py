"""Templates of license notices and texts, in the markup that ``license_scan`` compiles.

``<<beginOptional>>`` .. ``<<endOptional>>`` may be left out. ``<<var;name=..;words=a-b>>`` stands for any a to b words, and
``<<var;name=..;match=x|y>>`` for one of the words given. All other words are mandatory. Case and everything between words
(letters, digits and characters beyond ASCII make words) are of no account.
"""

from __future__ import annotations

#: Phrases of the result's base labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

_GIVEN = "<<var;name=verb;match=licensed|released|distributed|published|available|provided>> under <<beginOptional>>the terms of <<beginOptional>>version 2 of <<endOptional>><<endOptional>><<beginOptional>>the<<endOptional>>"
_VERSION = "<<beginOptional>>either<<endOptional>> <<beginOptional>>version<<endOptional>> {} <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or later<<endOptional>>"
_GNU = "<<beginOptional>>gnu<<endOptional>> {} <<beginOptional>>as published by the free software foundation<<endOptional>> {}"

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;words=1-20>> BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
<<var;name=holder;words=1-20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL <<var;name=liable;words=1-20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organization;words=1-20>> nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;name=holder;words=1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;name=work;words=1-6>> except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_GPL_NOTICE = """This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation<<beginOptional>>, either<<endOptional>> version {} of the License
<<beginOptional>>, or (at your option) any later version<<endOptional>>"""


def _templates() -> list[tuple[str, str, str]]:
    """(name, label, markup)."""
    out = [
        ("mit-notice", "mit", f"{_GIVEN} MIT License"),
        ("mit-text", "mit", _PERMISSION),
        ("isc-text", "isc", _ISC),
        ("bsd-2-clause-text", "bsd-2-clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
        ("bsd-3-clause-text", "bsd-3-clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
        ("bsd-notice", "bsd", f"{_GIVEN} <<beginOptional>><<var;name=clauses;match=2|3|two|three>> clause<<endOptional>> BSD License"),
        ("apache-notice", "apache-2.0", f"{_GIVEN} Apache License <<beginOptional>>version<<endOptional>> 2.0"),
        ("apache-header", "apache-2.0", _APACHE_NOTICE),
        ("mpl-notice", "mpl-2.0", f"{_GIVEN} Mozilla Public License <<beginOptional>>version<<endOptional>> 2.0"),
        ("cc0-notice", "cc0-1.0", f"{_GIVEN} <<beginOptional>>creative commons<<endOptional>> CC0 1.0 <<beginOptional>>universal<<endOptional>>"),
    ]
    for label, words in (("gpl", "general public license"), ("lgpl", "lesser general public license"), ("agpl", "affero general public license")):
        for v in ("2", "2.1", "3"):
            name = f"{label}-{v if '.' in v else v + '.0'}"
            out.append((f"{name}-notice", name, f"{_GIVEN} {_GNU.format(words, _VERSION.format(v))}"))
    out += [(f"gpl-{v}-header", f"gpl-{v}.0", _GPL_NOTICE.format(v)) for v in ("2", "3")]
    # every Creative Commons kind and version, by short and by long name
    kinds = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
    for kind, words in kinds.items():
        for v in ("2.0", "3.0", "4.0"):
            label = f"cc-{kind}-{v}"
            out.append((f"{label}-notice", label, f"{_GIVEN} <<beginOptional>>a<<endOptional>> CC {kind} {v} <<beginOptional>>license<<endOptional>>"))
            out.append((f"{label}-long", label, f"{_GIVEN} <<beginOptional>>a<<endOptional>> creative commons {words} {v} <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>"))
    # machine-readable identifiers: the words of the label are mandatory
    out += [(f"{x}-id", x, f"SPDX-License-Identifier: {x} <<beginOptional>><<var;name=rest;match=only|later>><<endOptional>>") for x in ("mit", "apache-2.0", "isc", "bsd-2-clause", "bsd-3-clause", "mpl-2.0", "gpl-2.0", "gpl-3.0", "lgpl-3.0", "agpl-3.0")]
    return out


TEMPLATES = _templates()
