"""Spellings taken as equal, and public licence texts and notices."""

import re

# (variant, standard) in this order; matched anywhere in lower-case text.
SPELLINGS = [
    ("licence", "license"), ("organis", "organiz"), ("recognis", "recogniz"), ("realis", "realiz"),
    ("utilis", "utiliz"), ("initialis", "initializ"), ("merchantib", "merchantab"), ("sub license", "sublicense"),
    ("sub-license", "sublicense"), ("behaviour", "behavior"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("non-infringement", "noninfringement"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
    ("https://", "http://"),
]

_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
          "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
          "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
          "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
          "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\n" + _AS_IS)
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
              "hereby granted")
_ISC_END = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
            "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
            "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_GRANT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
              "that the following conditions are met:\n\n1. Redistributions of source code must retain the above "
              "copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary "
              "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
              "the documentation and/or other materials provided with the distribution.\n\n")
_BSD_NAME = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission.\n\n")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
            "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE.")

_ISC = _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
         "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this "
         "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
         "to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim "
         "that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
         "documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as "
         "such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or "
         "altered from any source distribution.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, "
              "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
              "for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright "
              "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
              "public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
              "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
              "present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
              "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
              "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
              "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
              "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BOOST = ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
          "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
          "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
          "to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software "
          "and this entire statement, including the above license grant, this restriction and the following disclaimer, must "
          "be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless "
          "such copies or derivative works are solely in the form of machine-executable object code generated by a source "
          "language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
          "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND "
          "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY "
          "DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
          "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_APACHE_HEADER = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at\n\n"
                  "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
                  "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                  "limitations under the License.")
_MPL_HEADER = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")


def _gnu_header(license_name: str, version: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {license_name} "
            f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
            "later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
            f"even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license_name} for "
            f"more details.\n\nYou should have received a copy of the GNU {license_name} along with this program. If not, see "
            "<https://www.gnu.org/licenses/>.")


# (name, text, titles that may stand above the text)
_WHOLE = [
    ("MIT", _MIT, ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)"]),
    ("ISC", _ISC, ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License:"]),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END, ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero-Clause License (0BSD)"]),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_END, ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License",
                                             "Simplified BSD License", "BSD License"]),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_NAME + _BSD_END, ["BSD 3-Clause License", "The BSD 3-Clause License",
                                                         "The 3-Clause BSD License", "New BSD License", "BSD License"]),
    ("Zlib", _ZLIB, ["zlib License", "The zlib License", "The zlib/libpng License"]),
    ("Unlicense", _UNLICENSE, ["The Unlicense"]),
    ("BSL-1.0", _BOOST, ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"]),
    ("Apache-2.0 notice", _APACHE_HEADER, []), ("MPL-2.0 notice", _MPL_HEADER, []),
    ("GPL-2.0-or-later notice", _gnu_header("General Public License", "2"), []),
    ("GPL-3.0-or-later notice", _gnu_header("General Public License", "3"), []),
    ("LGPL-3.0-or-later notice", _gnu_header("Lesser General Public License", "3"), []),
    ("AGPL-3.0-or-later notice", _gnu_header("Affero General Public License", "3"), []),
]

# (name, text); lists of conditions are written with numbers or with bullets.
KNOWN_TEXTS = [(name, f"{title}\n\n{body}" if title else body) for name, text, titles in _WHOLE for title in ["", *titles]
               for body in dict.fromkeys([text, re.sub(r"(?m)^\d\. ", "* ", text)])] + [
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0 notice", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT notice", "Released under the MIT License."),
    ("MIT notice", "Licensed under the MIT License."),
    ("All rights reserved", "All rights reserved."),
]
