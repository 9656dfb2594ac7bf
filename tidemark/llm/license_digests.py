"""Public licence texts too long to be listed here, as SPDX identifier, words, first four words and md5 of the canonical text
(see licenses.canonical). Short texts are in license_texts.
"""

from __future__ import annotations

#: The folder of licence texts that Debian's base-files package installs, and its files: `python -m tidemark.llm.make_license_digests` makes these rows.
FOLDER = "/usr/share/common-licenses"
FILES = [
    ("Apache-2.0", 1583, "apache license v 2", "1de021e49aded84d55ca57c3a7d37db4", "Apache-2.0"),
    ("Artistic-1.0-Perl", 950, "the artistic license preamble", "1b50375157aa8fd583048ea2d79fcfc6", "Artistic"),
    ("CC0-1.0", 1075, "creative commons legal code", "a70bebfe5da688ca288b05ca74c12b51", "CC0-1.0"),
    ("GFDL-1.2-only", 3305, "gnu free documentation license", "069ba4e5f393c278141547571ce3a0c1", "GFDL-1.2"),
    ("GFDL-1.3-only", 3710, "gnu free documentation license", "2d8e0926b38b85c80ae929d9ac7fde59", "GFDL"),
    ("GPL-1.0-only", 2055, "gnu general public license", "8827365a843c87ec6763b6e1ac5aac0d", "GPL-1"),
    ("GPL-2.0-only", 2965, "gnu general public license", "41deab1586ba0abbce56a703d34e6730", "GPL-2"),
    ("GPL-3.0-only", 5650, "gnu general public license", "10a1cad28328416f2277b45ee157f35f", "GPL"),
    ("LGPL-2.0-only", 4153, "gnu library general public", "b4d15708223707d6acf71b5819a7ddba", "LGPL-2"),
    ("LGPL-2.1-only", 4354, "gnu lesser general public", "1271d1420206103d453dd1b12c0fc7f8", "LGPL-2.1"),
    ("LGPL-3.0-only", 1231, "gnu lesser general public", "fdc10443c5a1e68178d8300ca10bcdc1", "LGPL"),
    ("MPL-1.1", 3786, "mozilla public license v", "ead01a0529c0356c5159b4cfa701ce71", "MPL-1.1"),
    ("MPL-2.0", 2426, "mozilla public license v", "0349217a8e408bdbc3e28e3c126a774a", "MPL-2.0"),
]

#: Other wordings that published packages carry in their licence files; the texts are not kept here, so these rows can be used but not made again.
MORE = [
    ("Apache-2.0", 86, "licensed under the apache", "bac6321ea256c793c961d19060b6fe03"),
    ("Apache-2.0", 1407, "apache license v 2", "39713efab1c0482c99e49c816d908410"),
    ("Apache-2.0", 1412, "apache license v 2", "851f7aa2333642507c3580cc76cf377e"),
    ("Apache-2.0", 1427, "apache license v 2", "86923f0b515ce95669c6df90b4774fbe"),
    ("Apache-2.0", 1602, "apache license v 2", "0d3352e970c8f46af1db429ce1f7d4b5"),
    ("Apache-2.0", 1586, "apache license v 2", "4d8e841aaf40c6e74d279d6cbcea1ebb"),
    ("Apache-2.0", 1592, "apache license v 2", "299b0a1cfe11d0b5686695144abcfcfd"),
    ("BSD-2-Clause", 174, "redistribution and use in", "009040c5652a78fb696de3da3a043be6"),
    ("BlueOak-1.0.0", 251, "blue oak model license", "38ceb95d2c63ddb72a42e87e9ec05e45"),
    ("GPL-2.0-only", 2947, "gnu general public license", "6c46ace35b82376d5023640c03ad3232"),
    ("GPL-2.0-only", 2965, "gnu general public license", "628c666af7aa82bf014211d91ecf19c1"),
    ("GPL-3.0-only", 5650, "gnu general public license", "de8530f9e0c92da799f8ec5ac1b3fd8f"),
    ("ISC", 102, "permission to use copy", "29dda87f10ab224ba76781ee87d28d03"),
    ("ISC", 111, "permission to use copy", "a2f4d54b6390fc9fca81f9bea56ab4d8"),
    ("ISC", 112, "permission to use copy", "753cdd70cd6aad81522b5aa49ab9f496"),
    ("ISC", 113, "isc license permission to", "7d853a1f24bf9c4e666e9df21f381124"),
    ("ISC", 114, "isc license isc permission", "8df9b56056af284d51598b1b5751fead"),
    ("ISC", 114, "isc license permission to", "8250774e9dca737d69a6006d85c96a49"),
    ("ISC", 114, "the isc license permission", "06ce8287ce2d8a4368c788a67843d6ab"),
    ("ISC", 115, "isc license isc permission", "e5f70f92790d5b77d2c31a9f07997d5d"),
    ("ISC", 115, "the isc license isc", "d63506ab7435bc5c7d78c1198ce6a746"),
    ("ISC", 115, "the isc license permission", "e889ea62b85f3389a97fe6f3e80996cf"),
    ("ISC", 116, "the isc license isc", "9bb434d4a45caddee2f510555b91e2b1"),
    ("LGPL-2.0-only", 4154, "gnu library general public", "5033b3bde4c16964625472f3db84ba2c"),
    ("LGPL-2.1-only", 4336, "gnu lesser general public", "86e967ba65865d4d9ef503e214922f0c"),
    ("MIT", 159, "this software is released", "f4806718c3e81b5828bab9b05fe2de38"),
    ("MIT", 166, "mit license mit permission", "267835a5b13808cd084b9abe3f2a1877"),
    ("MIT", 171, "this software is released", "40e6a54ee7f2158d26312cf0103cb9c1"),
    ("Unlicense", 200, "unlicense this is free", "387c6fd2d5005c66af88b8d90e69ea73"),
]

TEXTS = [r[:4] for r in FILES] + MORE
