"""Known licences: whole texts, digests of longer ones, and one-line notices (fixed values; the words of the public licences)."""

from __future__ import annotations

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)

#: Licence id, whole text. Titles are optional in practice, so texts are known with and without them.
TEXTS: tuple[tuple[str, str, str], ...] = (
    ("MIT", "MIT License", f"{_GRANT} {_AS_IS}"),
    ("MIT", "The MIT License (MIT)", f"{_GRANT} {_AS_IS}"),
    ("BSD-2-Clause", "BSD 2-Clause License", f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_TAIL}"),
    ("BSD-3-Clause", "BSD 3-Clause License", f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_TAIL}"),
    ("ISC", "ISC License", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}"),
    ("0BSD", "Zero-Clause BSD", f"{_ISC_GRANT}. {_ISC_TAIL}"),
)

#: Longer licences by their canonical text: id, characters, first word, SHA-256 (fixed values, from the published texts; the
#: second of an id is without what follows "END OF TERMS AND CONDITIONS").
DIGESTS: tuple[tuple[str, int, str, str], ...] = (
    ("Apache-2.0", 9865, "apache", "0be25ae8b112b6c47bf696a745855eebba678079747ad8bbf877d928555027f1"),
    ("Apache-2.0", 8809, "apache", "9446b99128ec9c3946adbb681853599f3a5f01a69d6c0762a9d0ab699868d801"),
    ("CC0-1.0", 6691, "creative", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GPL-2.0", 17117, "gnu", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", 14483, "gnu", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", 33406, "gnu", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", 30968, "gnu", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.1", 25217, "gnu", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", 23365, "gnu", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", 7104, "gnu", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", 14272, "mozilla", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
    ("MPL-1.1", 22319, "mozilla", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("GPL-1.0", 11765, "gnu", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", 9415, "gnu", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GFDL-1.3", 22013, "gnu", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("Artistic-1.0", 5833, "the", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("Unlicense", 1171, "this", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
)

#: Licence id, the names that notices call it by.
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MIT License", "MIT")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "BSD-3-Clause")),
    ("ISC", ("ISC License", "ISC")),
    ("0BSD", ("Zero-Clause BSD License", "0BSD")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0")),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0 1.0", "Creative Commons Zero v1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
)

#: How one-line notices read, around a name.
NOTICES: tuple[str, ...] = (
    "{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}",
    "This project is licensed under the {}", "This software is released under the {}", "Available under the {}",
    "SPDX-License-Identifier: {}", "License: {}",
)


def known() -> list[tuple[str, str, str]]:
    """(licence id, kind, text) of every known text."""
    whole = [(i, "text", t) for i, title, body in TEXTS for t in (body, f"{title}\n\n{body}")]
    return whole + [(i, "notice", form.format(name)) for i, names in NAMES for name in names for form in NOTICES]
