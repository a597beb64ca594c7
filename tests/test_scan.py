import pytest

from mnemospark.functions.scan import scan

CASES = {
    "lib/point.c": (
        '#include <stdio.h>\n#include "util.h"\ntypedef struct {\n  int x;\n} Point;\nstruct Node { struct Node *next; };\n/* void ghost() { } */\nvoid show(Point p) {\n  printf("call() {%d\\n", p.x); // hidden()\n  if (p.x) reset(p);\n}\nint proto(int a);\n',
        {"lib/point.c": "file", "show": "function", "Node": "struct"},
        [("lib/point.c", "imports", "stdio.h"), ("lib/point.c", "imports", "util.h"), ("show", "calls", "printf"), ("show", "calls", "reset")],
        ["ghost", "proto", "hidden", "call"],
    ),
    "src/zoo.cpp": (
        "#include <vector>\nnamespace zoo {\nclass Animal {\npublic:\n  virtual void speak() = 0;\n};\nclass Dog : public Animal, private Pet<int> {\npublic:\n  void speak() override { bark(); }\n};\nvoid Dog::run() const { speak(); }\n}\n",
        {"zoo::Animal": "class", "zoo::Dog": "class", "zoo::Dog::speak": "function", "zoo::Dog::run": "function", "zoo": "module"},
        [("src/zoo.cpp", "imports", "vector"), ("zoo::Dog", "extends", "Animal"), ("zoo::Dog", "extends", "Pet"), ("zoo::Dog::speak", "calls", "bark"), ("zoo::Dog::run", "calls", "speak")],
        [],
    ),
    "S/Repo.cs": (
        "using System;\nusing System.Collections.Generic;\nnamespace My.App {\n  public interface IRepo {\n    string Find(string id);\n  }\n  public class UserRepo : IRepo {\n    public string Find(string id) { return Load(id); }\n  }\n}\n",
        {"My.App.IRepo": "interface", "My.App.UserRepo": "class", "My.App.UserRepo.Find": "method", "My.App.IRepo.Find": "method"},
        [("S/Repo.cs", "imports", "System"), ("S/Repo.cs", "imports", "System.Collections.Generic"), ("My.App.UserRepo", "extends", "IRepo"), ("My.App.UserRepo.Find", "calls", "Load")],
        [],
    ),
    "a/Hello.java": (
        'package org.demo;\nimport java.util.List;\nimport static org.demo.Util.*;\npublic interface Greeter { String greet(String name); }\npublic class Hello extends Base implements Greeter, Closeable {\n  @Override public List<String> greet(String name) throws IOException {\n    Runnable r = new Runnable() { public void run() { inner(); } };\n    return list("class Fake { }" + name);\n  }\n  enum Mood { GOOD }\n}\n',
        {"org.demo.Greeter": "interface", "org.demo.Greeter.greet": "method", "org.demo.Hello": "class", "org.demo.Hello.greet": "method", "org.demo.Hello.Mood": "type"},
        [("a/Hello.java", "imports", "java.util.List"), ("a/Hello.java", "imports", "org.demo.Util.*"), ("org.demo.Hello", "extends", "Base"), ("org.demo.Hello", "implements", "Greeter"), ("org.demo.Hello", "implements", "Closeable"), ("org.demo.Hello.greet", "calls", "list")],
        ["Fake"],
    ),
    "pay/v1/pay.proto": (
        'syntax = "proto3";\npackage pay.v1;\nimport "google/any.proto";\nmessage Payment { int64 id = 1; message Line { } }\nservice Pay {\n  rpc Create (Payment) returns (stream Receipt);\n}\n',
        {"pay.v1.Payment": "struct", "pay.v1.Payment.Line": "struct", "pay.v1.Pay": "interface", "pay.v1.Pay.Create": "method"},
        [("pay/v1/pay.proto", "imports", "google/any.proto"), ("pay.v1.Pay.Create", "uses", "Payment"), ("pay.v1.Pay.Create", "uses", "Receipt")],
        [],
    ),
    "x/auth/token.go": (
        'package auth\n\nimport (\n\t"context"\n\tm "math"\n)\nimport "fmt"\n\ntype Token struct {\n\tID string\n}\ntype Storer interface {\n\tReader\n\tLookup(ctx context.Context) (*Token, error)\n}\ntype ID string\ntype (\n\tA struct{ x int }\n\tB int\n)\n\nfunc (s *Store[T]) Lookup(ctx context.Context) (res *Token, err error) {\n\tfmt.Println("x() {")\n\tfunc() { go work() }()\n\treturn nil, nil\n}\nfunc (r Repo) Get() {}\nfunc Verify(f func(int) error) error {\n\treturn store.Lookup(`raw {`)\n}\nvar cookie = "session"\nconst (\n\tOne = iota\n\tTwo\n)\n',
        {"auth.Token": "struct", "auth.Storer": "interface", "auth.ID": "type", "auth.A": "struct", "auth.B": "type", "auth.(*Store).Lookup": "method", "auth.(Repo).Get": "method", "auth.Verify": "function", "auth.cookie": "variable", "auth.One": "variable", "auth.Two": "variable"},
        [("x/auth/token.go", "imports", "context"), ("x/auth/token.go", "imports", "math"), ("x/auth/token.go", "imports", "fmt"), ("auth.Storer", "extends", "Reader"), ("auth.Verify", "calls", "Lookup"), ("auth.(*Store).Lookup", "calls", "Println"), ("auth.(*Store).Lookup", "calls", "work"), ("x/auth/token.go", "defines", "auth.Verify")],
        ["auth.res", "auth.err", "auth.x"],
    ),
    "src/repo.ts": (
        "import { Pool } from 'pg';\nimport './side';\nexport interface Repository { find(id: string): Promise<User>; }\nexport class UserRepo extends Base implements Repository, Other {\n  constructor(private pool: Pool) { super(pool); }\n  async find(id: string): Promise<User> { return this.pool.query(`x${id} () {`); }\n}\nexport function createRepo(p: Pool): UserRepo { return build(p); }\nconst arrow = async (x: number) => { helper(x); };\nlet count = 3;\ntype Alias = { a: number };\nconst old = require('fs');\n",
        {"repo.Repository": "interface", "repo.Repository.find": "method", "repo.UserRepo": "class", "repo.UserRepo.find": "method", "repo.createRepo": "function", "repo.arrow": "function", "repo.count": "variable", "repo.Alias": "type"},
        [("src/repo.ts", "imports", "pg"), ("src/repo.ts", "imports", "./side"), ("src/repo.ts", "imports", "fs"), ("repo.UserRepo", "extends", "Base"), ("repo.UserRepo", "implements", "Repository"), ("repo.UserRepo", "implements", "Other"), ("repo.UserRepo.find", "calls", "query"), ("repo.createRepo", "calls", "build"), ("repo.arrow", "calls", "helper")],
        [],
    ),
    "src/cache.rs": (
        "use std::collections::{HashMap, hash_map::{self, Entry as E}};\npub use crate::x;\npub struct Cache<'a> { map: HashMap<&'a str, char> }\npub trait Store { fn get(&self, key: &str) -> Option<String>; }\nimpl<'a> Store for Cache<'a> {\n  fn get(&self, key: &str) -> Option<String> { let c = '{'; self.load(key) }\n}\npub fn new_cache() -> Cache<'static> { Cache::build() }\nmod inner { pub enum Kind { A } fn deep() { other(); } }\nconst LIMIT: usize = 3;\n",
        {"cache::Cache": "struct", "cache::Store": "interface", "cache::Store::get": "method", "cache::Cache::get": "method", "cache::new_cache": "function", "cache::inner": "module", "cache::inner::Kind": "type", "cache::inner::deep": "function", "cache::LIMIT": "variable"},
        [("src/cache.rs", "imports", "std::collections::HashMap"), ("src/cache.rs", "imports", "std::collections::hash_map"), ("src/cache.rs", "imports", "std::collections::hash_map::Entry"), ("src/cache.rs", "imports", "crate::x"), ("cache::Cache", "implements", "Store"), ("cache::Cache::get", "calls", "load"), ("cache::new_cache", "calls", "build"), ("cache::inner::deep", "calls", "other")],
        [],
    ),
    "bin/hi.sh": (
        '#!/bin/bash\nsource ./lib.sh\nhi() {\n  echo "hello $1 }"\n  if ready; then cleanup; fi\n  # ghost\n}\nfunction cleanup {\n  rm -f x\n}\n',
        {"bin/hi.sh": "file", "hi.hi": "function", "hi.cleanup": "function"},
        [("bin/hi.sh", "imports", "./lib.sh"), ("hi.hi", "calls", "cleanup"), ("hi.hi", "calls", "ready"), ("hi.cleanup", "calls", "rm")],
        ["ghost"],
    ),
    "main.tf": (
        'variable "region" {}\nresource "aws_s3_bucket" "mine" {\n  tags { a = "b" }\n}\nmodule "net" {\n  source = "./modules/net"\n}\n',
        {"main.tf": "file", "resource.aws_s3_bucket.mine": "variable", "module.net": "module", "variable.region": "variable"},
        [("module.net", "imports", "./modules/net")],
        [],
    ),
    "a/main.css": ('@import "reset.css";\n@import url("fonts.css");\n.box { a: b; }\n#top { c: d; }\n', {"a/main.css": "file", ".box": "variable", "#top": "variable"}, [("a/main.css", "imports", "reset.css"), ("a/main.css", "imports", "fonts.css")], []),
    "Dockerfile": ("FROM golang:1.22 AS builder\nRUN go build\nFROM --platform=x base/static\n", {"Dockerfile": "file", "builder": "variable"}, [("Dockerfile", "imports", "golang:1.22"), ("Dockerfile", "imports", "base/static")], []),
    "Cargo.toml": ('[package]\nname = "x"\n[[bin]]\n', {"Cargo.toml": "file", "package": "variable", "bin": "variable"}, [], []),
    "service.yaml": ("name: x\ndeps:\n  - a: b\n", {"service.yaml": "file", "name": "variable", "deps": "variable"}, [], ["a"]),
}


@pytest.mark.parametrize("path", CASES)
def test_symbols_and_edges_of_a_language(path):
    source, kinds, edges, absent = CASES[path]
    symbols, found = scan(path, source)
    got = {n: k for k, n, *_ in symbols}
    assert {n: got.get(n) for n in kinds} == kinds
    assert [e for e in edges if e not in found] == []
    assert not {n for n in got if n.rsplit(".", 1)[-1] in absent or n in absent}
    assert not {o for _, p, o in found if p == "calls" and o in absent}


def test_symbols_span_their_bodies():
    source = "package p\nfunc A() {\n\tb()\n}\ntype T struct {\n\tx int\n}\n"
    spans = {n: source[a:z] for k, n, a, z in scan("p.go", source)[0]}
    assert spans["p.A"] == "func A() {\n\tb()\n}" and spans["p.T"].endswith("x int\n}")


@pytest.mark.parametrize("source", [None, "", "}}}", "{{{", "func (", "class", "class X {", "import", "use a::{b", "'", '"', "`", "/*", "#include", "fn f(", "package", "type (", "const (", "namespace", "a(b(c", "impl<", "enum class"])
def test_broken_sources_end_and_give_the_file(source):
    for end in ("go", "rs", "ts", "java", "kt", "cs", "c", "cpp", "proto"):
        assert scan(f"x.{end}", source)[0][0][:2] == ("file", f"x.{end}")
    assert scan("README", "func x() {}") == ([], []) and scan("a.txt", "class X {}") == ([], [])


def test_long_sources_take_time_in_proportion():
    source = "package p\n" + "".join(f"func F{i}(a int) error {{ return g{i}(a) }}\n" for i in range(20_000))
    symbols, edges = scan("p.go", source)
    assert len(symbols) == 20_001 and ("p.F19999", "calls", "g19999") in edges
