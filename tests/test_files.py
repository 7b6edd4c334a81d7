"""Scanning, extraction and resolution on small trees, all languages in one table."""

import os

import pytest

from helpers import files_df
from linkloom.functions.languages import ScanOptions
from linkloom.operators.extract import detect_languages, scan_files
from linkloom.operators.resolve import file_graph, resolve_imports
from linkloom.operators.extract import extract_imports
from linkloom.sources.trees import find_files, read_tree

# repo -> (files, [(source, target, is_external)])
TREES = {
    "c": ({"main.c": '#include <stdio.h>\n#include "utils.h"\n#include "math_ops.h"\nint x; #include "late.py"\n',
           "utils.c": '#include "utils.h"\n', "utils.h": "#include <stdlib.h>\n", "deep/er/only.h": "", "deep/only.h": "",
           "b/user.c": '#include "only.h"\n#include "../utils.h"\n'},
          [("main.c", "stdio.h", True), ("main.c", "utils.h", False), ("main.c", "math_ops.h", False),
           ("utils.c", "utils.h", False), ("utils.h", "stdlib.h", True), ("b/user.c", "deep/only.h", False),
           ("b/user.c", "utils.h", False)]),
    "py": ({"main.py": "import os, app\nimport json as j\nfrom utils.helpers import (\n    a,\n    b,\n)\nfrom . import config, gone as g, *\n"
                       "  import hidden\nfrom numpy import array\nimport app # no\n",
            "app/__init__.py": "from .models.user import User\nfrom ..config import x\n", "app/models/user.py": "",
            "utils/helpers.py": "from __future__ import annotations\n", "config.py": ""},
           [("main.py", "os", True), ("main.py", "app/__init__.py", False), ("main.py", "utils/helpers.py", False),
            ("main.py", "config.py", False), ("main.py", "gone as g.py", False), ("main.py", "numpy", True),
            ("app/__init__.py", "app/models/user.py", False), ("app/__init__.py", "config.py", False),
            ("utils/helpers.py", "__future__", True)]),
    "js": ({"index.js": "import App from './App';\nimport 'react';\nconst {a,\n b} = 1\nimport {\n x } from './late'\n",
            "App.js": "import H from './components/Header'\nconst u = require('./lib')\n", "components/Header.tsx": "import '../missing.css'\n",
            "lib/index.ts": "", "late.js": ""},
           [("index.js", "App.js", False), ("index.js", "react", True), ("App.js", "components/Header.tsx", False),
            ("App.js", "lib/index.ts", False), ("components/Header.tsx", "missing.css", False)]),
    "java": ({"com/a/Main.java": "import com.b.*;\nimport com.b.sub.Deep;\nimport java.util.List;\n", "com/b/X.java": "",
              "com/b/Y.java": "", "com/b/sub/Deep.java": ""},
             [("com/a/Main.java", "com/b/X.java", False), ("com/a/Main.java", "com/b/Y.java", False),
              ("com/a/Main.java", "com/b/sub/Deep.java", False), ("com/a/Main.java", "java.util.List", True)]),
    "go": ({"go.mod": "// c\nmodule  example.com/app \n", "main.go": 'import (\n "fmt"\n "example.com/app/pkg/util"\n)\nimport "example.com/app/none"\n',
            "pkg/util/u.go": 'import "example.com/app"\n'},
           [("main.go", "fmt", True), ("main.go", "pkg/util", False), ("main.go", "example.com/app/none", True),
            ("pkg/util/u.go", "example.com/app", True)]),
    "rust": ({"main.rs": "mod a;\npub(crate) mod b;\nmod none;\nuse crate::a::inner;\nuse crate::gone::x;\nuse std::io;\nextern crate serde as s;\n",
              "a.rs": "use self::b;\n", "b/mod.rs": "use super::a;\n", "a/inner.rs": "use super::super::a;\nuse super::a;\n"},
             [("main.rs", "a.rs", False), ("main.rs", "b/mod.rs", False), ("main.rs", "none.rs", False),
              ("main.rs", "a/inner.rs", False), ("main.rs", "std", True), ("main.rs", "serde", True), ("a.rs", "b/mod.rs", False),
              ("b/mod.rs", "a.rs", False), ("a/inner.rs", "a.rs", False), ("a/inner.rs", "a.rs", False)]),
    "cs": ({"App/Main.cs": "using System.Linq;\nusing App.Models;\nusing App.Models.User;\nusing Root;\nusing Some.Data_Set.Thing;\nusing Nowhere.X;\nusing static My_Dir;\nnamespace App {\n",
            "M/User.cs": "namespace App.Models;\n", "M/Order.cs": "  namespace App.Models {\n", "R/R.cs": "namespace Root.Inner;\n",
            "Data-Set/Thing.cs": "", "my-dir/Z.cs": ""},
           [("App/Main.cs", "System.Linq", True), ("App/Main.cs", "M/Order.cs", False), ("App/Main.cs", "M/User.cs", False),
            ("App/Main.cs", "M/User.cs", False), ("App/Main.cs", "R/R.cs", False), ("App/Main.cs", "Data-Set/Thing.cs", False),
            ("App/Main.cs", "Nowhere.X", True), ("App/Main.cs", "my-dir/Z.cs", False)]),
    "swift": ({"App.swift": "import Foundation\n@testable import Core\nimport struct Models.User\nimport Other\n", "Core/a/X.swift": "", "Deep/User.swift": ""},
              [("App.swift", "Foundation", True), ("App.swift", "Core", False), ("App.swift", "Deep/User.swift", False), ("App.swift", "Other", True)]),
    "ruby": ({"app/main.rb": "require 'json'\nrequire_relative 'user'\nrequire_relative '../gone'\nrequire 'lib/tool'\nload 'x.rb'\nrequire \"pg\"\n",
              "app/user.rb": "", "lib/tool.rb": "", "x.rb": ""},
             [("app/main.rb", "json", True), ("app/main.rb", "app/user.rb", False), ("app/main.rb", "gone.rb", False),
              ("app/main.rb", "lib/tool.rb", False), ("app/main.rb", "x.rb", False), ("app/main.rb", "pg", True)]),
    "kotlin": ({"Main.kt": "import com.a.Foo\nimport com.a.*\nimport com.a.Foo.bar as b\nimport javafoo.X\nimport org.none.Y\n", "com/a/Foo.kt": "", "com/a/Bar.kts": ""},
               [("Main.kt", "com/a/Foo.kt", False), ("Main.kt", "com/a/Bar.kts", False), ("Main.kt", "com/a/Foo.kt", False),
                ("Main.kt", "javafoo.X", True), ("Main.kt", "org.none.Y", True)]),
    "scala": ({"Main.scala": "import a.b.{X, Y}\nimport a.c._\nimport a.b.Z\nimport scala.util.Try\nimport zz.{Q}\n", "a/b.scala": "", "a/c/package.scala": ""},
              [("Main.scala", "a/b.scala", False), ("Main.scala", "a/c/package.scala", False), ("Main.scala", "a/b.scala", False),
               ("Main.scala", "scala.util.Try", True), ("Main.scala", "zz.{Q}", True)]),
    "php": ({"index.php": "use App\\Models\\User;\nuse App\\Models;\nuse App;\nuse Vendor\\src\\Tool;\nuse Symfony\\X;\nuse Nope\\Y;\nrequire_once('lib/f.php');\ninclude 'gone.php';\n",
             "m/User.php": "namespace App\\Models;\n", "m/Acc.php": "namespace App\\Models;\n", "src/Tool.php": "", "lib/f.php": ""},
            [("index.php", "m/User.php", False), ("index.php", "m/Acc.php", False), ("index.php", "m/Acc.php", False),
             ("index.php", "src/Tool.php", False), ("index.php", "Symfony\\X", True), ("index.php", "Nope\\Y", True),
             ("index.php", "lib/f.php", False), ("index.php", "gone.php", False)]),
    "dart": ({"lib/main.dart": "import 'dart:io';\nimport 'package:app/m/u.dart' show U;\nimport 'package:flutter/x.dart';\nimport 'm/u.dart' as u;\nimport 'gone.dart';\n", "lib/m/u.dart": ""},
             [("lib/main.dart", "dart:io", True), ("lib/main.dart", "lib/m/u.dart", False), ("lib/main.dart", "package:flutter/x.dart", True),
              ("lib/main.dart", "lib/m/u.dart", False), ("lib/main.dart", "lib/gone.dart", False)]),
    "elixir": ({"lib/a.ex": "alias MyApp.UserAgent\nuse GenServer\nimport Far.HTTPClient\nrequire Lost.Thing\n", "lib/my_app/user_agent.ex": "", "other/httpclient.exs": ""},
               [("lib/a.ex", "lib/my_app/user_agent.ex", False), ("lib/a.ex", "GenServer", True), ("lib/a.ex", "other/httpclient.exs", False),
                ("lib/a.ex", "Lost.Thing", True)]),
    "lua": ({"main.lua": 'local a = require("m.user")\nrequire "pkg"\nrequire("love.audio")\nrequire("x")\n', "m/user.lua": "", "pkg/init.lua": ""},
            [("main.lua", "m/user.lua", False), ("main.lua", "pkg/init.lua", False), ("main.lua", "love.audio", True), ("main.lua", "x", True)]),
    "zig": ({"src/main.zig": 'const s = @import("std");\nconst u = @import("u.zig");\nconst r = @import("root");\nconst z = @import("zz");\n', "src/u.zig": "", "root.zig": ""},
            [("src/main.zig", "std", True), ("src/main.zig", "src/u.zig", False), ("src/main.zig", "root.zig", False), ("src/main.zig", "zz", True)]),
    "haskell": ({"app/Main.hs": "import Prelude\nimport qualified Models.User as U\nimport Data.Local\nimport Far.Away\nimport No.Where\n", "src/Models/User.hs": "", "Data/Local.hs": "", "x/Away.hs": ""},
                [("app/Main.hs", "Prelude", True), ("app/Main.hs", "src/Models/User.hs", False), ("app/Main.hs", "Data.Local", True),
                 ("app/Main.hs", "x/Away.hs", False), ("app/Main.hs", "No.Where", True)]),
    "r": ({"a/main.R": 'library(dplyr)\nrequire("stats")\nsource("u.R")\nsource("lib/v.r")\nsource("gone.R")\n', "a/u.R": "", "lib/v.r": ""},
          [("a/main.R", "dplyr", True), ("a/main.R", "stats", True), ("a/main.R", "a/u.R", False), ("a/main.R", "lib/v.r", False), ("a/main.R", "a/gone.R", False)]),
}
# No Python file may be an include target while Python is on, so C's late.py line is checked apart.


@pytest.fixture(scope="module")
def resolved(spark):
    files = spark.createDataFrame([(repo, p, c) for repo, (tree, _) in TREES.items() for p, c in tree.items()],
                                  "repo string, path string, content string")
    options = ScanOptions.auto()
    scanned = scan_files(files, options)
    out = resolve_imports(extract_imports(scanned, options.enabled), scanned, files, options)
    return [r.asDict() for r in out.collect()]


@pytest.mark.parametrize("repo", sorted(TREES))
def test_imports_of(resolved, repo):
    got = sorted((r["src"], r["target"], r["is_external"]) for r in resolved if r["repo"] == repo)
    want = list(TREES[repo][1])
    if repo == "c":
        want.append(("main.c", "late.py", False))
    assert got == sorted(want)


def test_scan_rules_and_detection(spark):
    tree = {"src/a.py": "", "latest/b.py": "", "contest.py": "", "node_modules/c.py": "", "venv/d.py": "", "x/CMake.py": "",
            "e.js": "", "f.txt": "", "vendor/g.py": ""}
    files = files_df(spark, tree)
    assert sorted(r.path for r in scan_files(files, ScanOptions.single("py")).collect()) == [
        "node_modules/c.py", "src/a.py", "vendor/g.py"]
    flags = detect_languages(files).first()
    assert flags.has_py and flags.has_js and not flags.has_go


def test_options():
    assert ScanOptions().enabled == ("c", "h", "cpp")
    assert ScanOptions.single("c").enabled == ("c", "h") and ScanOptions.single("cpp").enabled == ("h", "cpp")
    assert len(ScanOptions.auto().enabled) == 20 and ScanOptions.auto(["py"]).enabled == ("py",)
    with pytest.raises(ValueError):
        ScanOptions(languages=["cobol"])


def test_hidden_externals_and_disabled_targets(spark):
    files = files_df(spark, TREES["c"][0])
    edges, _ = file_graph(files, ScanOptions(hide_external=True))
    assert sorted((r.source, r.target) for r in edges.collect()) == [
        ("b/user.c", "deep/only.h"), ("b/user.c", "utils.h"), ("main.c", "math_ops.h"), ("main.c", "utils.h"), ("utils.c", "utils.h")]


def test_tree_on_disk(spark, tmp_path):
    for name, data in {"a b/m.py": b"import os\r\nimport x\r", "tests/t.py": b"", "k.py": b"\xffok\n", "r.js": b""}.items():
        at = tmp_path / "proj" / name
        os.makedirs(at.parent, exist_ok=True)
        at.write_bytes(data)
    got = read_tree(spark, str(tmp_path / "proj"), ScanOptions.single("py"))
    assert sorted(tuple(r) for r in got.collect()) == [("proj", "a b/m.py", "import os\nimport x\n"), ("proj", "k.py", "ok\n")]


def test_find_files(spark):
    files = files_df(spark, {"a/x.py": "1\n2", "b/x.py": "", "c/y.go": ""})
    asked = spark.createDataFrame([("t", w) for w in ("a/x.py", "q/x.py", "y.go", "../a/x.py", "zz")], "repo string, wanted string")
    assert sorted((r.wanted, r.path, r.language, r.lines) for r in find_files(asked, files).collect()) == [
        ("../a/x.py", None, None, None), ("a/x.py", "a/x.py", "python", 2), ("q/x.py", "a/x.py", "python", 2),
        ("y.go", "c/y.go", "go", 1), ("zz", None, None, None)]


def test_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    from linkloom import store
    from linkloom.operators import resolve
    files = files_df(spark, TREES["js"][0])
    options = ScanOptions.single("js")
    scanned = scan_files(files, options)
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(resolve, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(store, "HOT_ROWS", 1)
    out = resolve_imports(extract_imports(scanned, options.enabled), scanned, files, options)
    assert sorted((r.src, r.target, r.is_external) for r in out.collect()) == sorted(TREES["js"][1])
