import pytest

from skein.functions.fixed import MORE_NODE_TYPES, NODE_TYPES
from skein.javascript.parser import parse

SOUND = [
    "if(a)b;else c", "for(const k of x){}", "for(let i=0,j=1;i<2;i++);", "for(k in o) z()", "async()=>{await f()}",
    "class A extends B{static x=1;#p=2;get y(){return 1} async *z(){} static{a}}", "a?.b?.[c]?.(d)", "label: for(;;)break label",
    "export default function(){}", "import a,{b as c} from 'x'", "x=/a[/]b/g.test(y)/2", "a<b>c", "`a${`b${c}`}`", "({a,b:c}=d)",
    "var {a:{b},c=1,...r}=q", '<a href="/x/y">t{u}</a>', "switch(a){case 1:b;default:c}", "try{a}catch{b}finally{c}",
    "new Foo(a).b()", "do x(); while(y)", "a=>({b:1})", "(a,b)=>a", "x = y\n/re/g", "return", "let async; async = 1", "yield",
    "!function(){}()", "0x1F + 1e5 + .5", "a = {get: 1, set, async, get x(){return 1}, [k]: 2, ...z}", "#!/usr/bin/env node\nvar a=1",
    "x\n++y", "a = function*(){yield* b}", "a ||= b", "import('x').then(y)", "/* c */", "",
]


@pytest.mark.parametrize("code", SOUND)
def test_sound_code_has_no_errors(code):
    assert [n.text for n, _ in parse(code).walk() if n.type == "ERROR"] == []


def test_types_are_of_the_catalogue():
    known = {*NODE_TYPES, *MORE_NODE_TYPES, "namespace_import", "import", "ERROR"}
    for code in SOUND:
        assert {n.type for n, _ in parse(code).walk(named_only=True)} <= known


@pytest.mark.parametrize("code", SOUND)
def test_tree_covers_the_text_in_order(code):
    root = parse(code)
    for node, _ in root.walk():
        last = node.start
        for child in node.children:
            assert last <= child.start <= child.end <= node.end
            assert child.parent is node
            last = child.end


def test_errors_leave_the_rest_readable():
    root = parse("var a = ;;; ) ] 'lost \n f('/found'); don't '/also/found'\n g(\"/last\")")
    texts = {n.text for n, _ in root.walk() if n.type == "string"}
    assert "'/found'" in texts and '"/last"' in texts
    assert any(n.type == "ERROR" for n, _ in root.walk())


def test_deep_and_long_code():
    assert parse("(" * 5000 + "x" + ")" * 5000).type == "program"
    assert parse("[" * 20000).type == "program"
    chain = parse(" + ".join(["'a'"] * 20000))
    assert sum(n.type == "string" for n, _ in chain.walk()) == 20000


def test_fields_and_comments():
    root = parse("f(/* in */ a) // after")
    call = root.children[0].children[0]
    assert call.get("function").text == "f"
    assert [c.type for c in call.get("arguments").named_children] == ["comment", "identifier"]
    assert root.children[-1].text == "// after"
