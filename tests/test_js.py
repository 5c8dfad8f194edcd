import pytest

from corpuslens.js import JsSyntaxError, inspect, parse
from corpuslens.js.facts import charset, static_string

GOOD = r"""
a=1
({a,b:[c=1,...d]}=x)
for(const [k,v] of Object.entries(x)){}
for(var i=0,n=3;i<n;i++);
async()=>{await x;for await(const a of b){}}
x=>({a:1})
(a,{b}={},...c)=>a+b
class A extends B{static #p=1;static{this.x=1} get y(){return 1} set y(v){} async *g(){} constructor(){super()} 'use'=1;get=2;static async m(){} [k](){}}
`a${b+`c${d}`}e`
tag`x\u{zz}`
a?.b?.[c]?.(d)
x = a ? b : c ? d : e
if(a)b;else c
label: for(;;){break label}
/re[/]x/gi.test(a)
a = b / c / d
import a,{b as c} from 'x'
import * as n from 'y' with {type:'json'}
export {a as default, b}; var a,b
export default function(){}
export * as q from 'z'
import('x')
import.meta.url
function f(){new.target}
a ||= b; c ??= d; e **= 2
var {a, b: {c = 2}, ...rest} = o
do x(); while(y) z()
switch(a){case 1: b; default: c}
try{}catch{}finally{}
(async function*(){yield* x; await y})
let async; async = 1; async(1)
var get = {get a(){return 1}, set a(v){}, get: 1, async: 2, async b(){}, *c(){}, [d]: 1, 'e': 2, 3: 4}
a => b => c
0x1F + 0b11 + 1_000n + .5e3
async (x, y) => x
const {[k]: v = 1} = o
for (let in_ in o);
for ([a,b] of y);
#!/usr/bin/env node
[a, , b] = c
x = function* () { const y = yield; }
class X { static async *[Symbol.iterator]() {} static = 1; async = 2; get; set }
(function(){ return /a/ })()
""".strip().split("\n")
BAD = {"a b": "Unexpected token (1:2)", "function(": "Unexpected token (1:8)", "({a=1})": None, "1=2": "Assigning to rvalue (1:0)", "import x from": "Unexpected token (1:13)", "for(const a;;);": None, "`abc": None, "'abc": "Unterminated string constant (1:0)", "if (": "Unexpected token (1:4)", "(a,b)=1": None, "return 1": "'return' outside of function (1:0)", "a?.b = 1": None, "async (x) \n => x": "Unexpected token (2:1)", "let [a]": None, "012": "Invalid number (1:0)", "with(a){}": None, "x = '😀' y": "Unexpected token (1:9)"}


@pytest.mark.parametrize("code", GOOD)
def test_parses(code):
    assert parse(code)["type"] == "Program"


@pytest.mark.parametrize("code", BAD)
def test_refuses(code):
    with pytest.raises(JsSyntaxError) as error:
        parse(code)
    assert BAD[code] is None or str(error.value) == BAD[code]


def test_script_goal_and_ambiguities():
    assert parse("return 012; with (a) {}", module=False, loose_return=True)["sourceType"] == "script"
    with pytest.raises(JsSyntaxError):
        parse("import 'x'", module=False)
    assert [s["type"] for s in parse("a\n++b\nc\n/d/g")["body"]] == ["ExpressionStatement"] * 3
    assert parse("(" * 60 + "a" + ")" * 60)["body"][0]["expression"]["type"] == "Identifier"
    with pytest.raises(JsSyntaxError, match="too deep"):
        parse("[" * 100_000)
    assert parse("'\\u{1F600}\\x41\\\n'")["body"][0]["expression"]["value"] == "😀A"


def facts(code):
    return inspect(code, parse(code))


def test_imports_and_bindings():
    f = facts("import a from './a'; export * from '#m'; const {readFile: r} = require('node:fs'); const s = require('child_process'); r('/x/.npmrc'); s.exec('ls'); require('b' + '/c'); require(x); import(`./d`)")
    assert sorted(f.imports) == [("#m", 1), ("./a", 1), ("./d", 1), ("b/c", 1), ("child_process", 1), ("child_process", 1), ("node:fs", 1)]
    assert f.externals == ["b/c", "child_process", "node:fs"]
    assert [(c["cap"], c["api"]) for c in f.caps] == [("fs", "fs.readFile"), ("shell", "child_process.exec")]
    assert [(d["kind"], d["literals"]) for d in f.dynamic] == [("require", ["b/c"]), ("require", None), ("import", ["./d"])]


def test_uses():
    f = facts("import fs from 'fs'\nfs.readFileSync('/home/u/.npmrc', 'utf8'); fs.rmSync(p)\nfetch('https://a.b/c'); http.get(u)\nprocess.env.X\neval('1'); eval(x); new Function(y); Function(z)")
    assert [(c["cap"], c["line"]) for c in f.caps] == [("fs", 2), ("secret-read", 2), ("fs", 2), ("fs-write", 2), ("net", 3), ("net", 3), ("env", 4)]
    assert [(n["api"], n["literals"]) for n in f.nets] == [("fetch", ["https://a.b/c"]), ("http.get", [])]
    assert [(e["kind"], e["literal"]) for e in f.evals] == [("eval", True), ("eval", False), ("Function", False)]
    assert facts("used(); import {exec as used} from 'child_process'").caps == []  # bound only from where it stands


def test_literals():
    blob = "QUJD" * 12 + "1="
    f = facts(f"a='{blob}'; b='{'0123456789abcdef' * 3}'; c='{'ab' * 30}'; String.fromCharCode(72,101,108,108,111,33,33,33); String.fromCharCode(1,2)")
    assert [e["charset"] for e in f.encoded] == ["base64", "hex"] and [c["chars"] for c in f.charcodes] == ["Hello!!!"]
    assert charset("aB" * 30) is None and charset("0aB" * 30) == "base64"
    assert static_string(parse("'a' + `b` + ('c' + 'd')")["body"][0]["expression"]) == "abcd"
