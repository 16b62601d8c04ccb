"""Licence templates: (label, notice, mandatory key phrases), after the public notices of the licences.

A label may have several templates. Key phrases are words as the scan takes them: lower case, one blank between."""

#: Our own choice.
TEMPLATES = (
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ("with or without fee is hereby granted",)),
    ("afl-3.0", "Licensed under the Academic Free License version 3.0", ("academic free license version 3 0",)),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu affero general public license",)),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License version 3", ("gnu affero general public license",)),
    ("apache-1.1", "The Apache Software License, Version 1.1", ("apache software license version 1 1",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', ("www apache org licenses license 2 0",)),
    ("artistic-2.0", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", ("artistic license 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License", ("bsd 2 clause",)),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products derived from this software",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost software license version 1 0",)),
    ("bsl-1.1", "Licensed under the Business Source License 1.1", ("business source license 1 1",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0 international",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial 4 0 international",)),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ("creative commons attribution noderivatives 4 0 international",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike 4 0 international",)),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", ("dedicated all copyright and related and neighboring rights",)),
    ("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.", ("common development and distribution license",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL", ("eupl version 1 2",)),
    ("gpl-2.0", "Licensed under the GNU General Public License version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license", "version 2 of the license")),
    ("gpl-3.0", "Licensed under the GNU General Public License version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "version 3 of the license")),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ("distributed in the hope that it will be useful",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("this permission notice appear in all copies",)),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu lesser general public license",)),
    ("mit", "Released under the MIT License", ("the mit license",)),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("included in all copies or substantial portions",)),
    ("mit-text", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY', ("the software is provided as is without warranty of any kind",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    ("ms-pl", "This source code is licensed under the Microsoft Public License (Ms-PL)", ("microsoft public license",)),
    ("ncsa", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution. Licensed under the University of Illinois/NCSA Open Source License", ("illinois ncsa open source license",)),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", ("sil open font license version 1 1",)),
    ("openssl", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", ("the openssl project",)),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.", ("without a written agreement is hereby granted",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("free and unencumbered software",)),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ("you want to public license",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("in no event will the authors be held liable",)),
    ("zpl-2.1", "This software is subject to the provisions of the Zope Public License, Version 2.1 (ZPL).", ("zope public license version 2 1",)),
)
