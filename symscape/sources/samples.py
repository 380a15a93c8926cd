"""Sources in every language that a scanner reads, with what they declare: recorded from the scanners and read through against the sources by hand, so they guard against changes more than against errors of reading."""

#: language -> (file name, text)
TEXTS = {
    "java": ('A.java', 'package a;\n@Service\npublic abstract class A<T> extends B<T> implements C, D {\n  private static final String KEY = "x";\n  public A(int x) { super(x); }\n  @Override public List<Map<String, T>> run(final List<T> xs, int... n) { return repo.find(xs); }\n  protected void hid() throws IOException, a.b.E { }\n}\nsealed interface S permits X, Y { int m(int a); }\nrecord P(int x, String y) {}\nenum E { A, B; }\n'),
    "csharp": ('a.cs', 'namespace N {\n[Serializable]\npublic class K : B, IFoo<int> {\n  public const int Max = 3;\n  private readonly Repo _r;\n  public K(int x) { }\n  [HttpGet("/x")]\n  public async Task<List<int>> RunAsync(string a, int b = 2) { await _r.Go(a); throw new BadEx(); }\n  int Hidden() => 1;\n}\npublic interface IFoo<T> { void M(T t); }\npublic record P(int X, string Y);\npublic enum E { A, B }\n}\n'),
    "kotlin": ('a.kt', 'package a\nconst val MAX = 3\ninterface I { fun m(x: Int): String }\ndata class D(val id: Int, val name: String) : I {\n  override fun m(x: Int): String = helper(x)\n  private fun p() { throw BadEx("x") }\n}\nfun top(a: List<Int>, b: String = "x"): Map<String, Int> {\n  val r = Repo()\n  r.go(a)\n  return x\n}\n'),
    "scala": ('a.scala', 'package a\ntrait T { def m(x: Int): String }\nclass C(val id: Int) extends T with U {\n  def m(x: Int): String = help(x)\n  private def p(): Unit = throw new BadEx\n}\nobject O { def apply(a: List[Int]): C = new C(1) }\ncase class P(x: Int, y: String)\n'),
    "swift": ('a.swift', 'protocol P { func m(x: Int) -> String }\npublic class C: Base, P {\n  init(x: Int) { }\n  public func m(x: Int) -> String { return help(x) }\n  private func q() throws -> Int { throw BadError.x }\n}\nstruct S { var a: Int; let b: String }\nenum E { case a, b }\nfunc top(_ a: Int, with b: String) -> [Int] { go(a) }\n'),
    "php": ('a.php', "<?php\nnamespace A;\ninterface I { public function m(int $x): string; }\nclass C extends B implements I {\n  const MAX = 3;\n  public function __construct(private Repo $r) {}\n  #[Route('/x')]\n  public function m(int $x, ?string $y = null): string { $this->r->go($x); throw new BadEx(); }\n  private function p() { return help(1); }\n}\nfunction top(array $a): int { return 1; }\n"),
    "c": ('a.c', '#include <x.h>\nstruct S { int a; char *b; };\nenum E { A, B };\nstatic int hid(int x) { return go(x); }\nint *run(struct S *s, const char *n) { hid(1); return 0; }\nvoid noargs(void) { }\n'),
    "cpp": ('a.cpp', 'namespace n {\nclass C : public B, private D {\npublic:\n  C(int x);\n  ~C();\n  virtual int run(const std::string& s) const override { return help(s); }\nprivate:\n  void p();\n};\nenum class E { A, B };\nint C::later(int x) { throw BadEx("x"); }\ntemplate <typename T> T top(std::vector<T> v) { return v.front(); }\n}\n'),
    "go": ('a.go', 'package g\nconst Max = 3\ntype I interface { Run(x int) error }\ntype T struct { A int; B string }\nfunc (t *T) Run(x int, y ...string) (int, error) { return t.help(x) }\nfunc New() *T { return &T{} }\n'),
    "rust": ('a.rs', 'pub const MAX: u32 = 3;\npub struct S { pub a: i32, b: String }\npub enum E { A, B(i32) }\npub trait T { fn m(&self, x: i32) -> String; }\nimpl T for S { fn m(&self, x: i32) -> String { self.help(x); panic!("") } }\nimpl S { pub fn new(a: i32) -> Self { S { a } } fn hid(&mut self) {} }\n#[derive(Debug)]\npub fn go<T: Clone>(x: &[T]) -> Result<Vec<T>, Err> where T: Copy { run(x) }\n'),
    "ruby": ('a.rb', 'module M\n  class C < B\n    attr_reader :a, :b\n    def initialize(x, y = 1)\n      go(x)\n    end\n    def run(z)\n      help(z)\n    end\n    private\n    def hid\n    end\n  end\nend\ndef top(a)\nend\n'),
    "lua": ('a.lua', 'local M = {}\nfunction M.run(a, b)\n  return help(a)\nend\nlocal function hid(x) end\nfunction M:self(x) end\nfunction top() end\n'),
    "bash": ('a.sh', '#!/bin/bash\nMAX=3\nhelp() {\n  echo x\n}\nfunction run {\n  help a\n}\n'),
    "css": ('a.css', '.a, #b:hover { --v: 1; color: red }\n@keyframes k { }\n'),
    "html": ('a.html', '<my-card id="x"></my-card>'),
}

#: (language, kind, name, signature, visibility, container, supers, calls)
DECLARED = [
    ('java', 'class', 'A', 'class A', 'pub', '', 'B,C,D', ''),
    ('java', 'const', 'KEY', 'KEY', 'pub', 'A', '', ''),
    ('java', 'ctor', 'A', 'A(int)', 'pub', 'A', '', ''),
    ('java', 'method', 'run', 'run(List<T>,int...):List<Map<String,T>>', 'pub', 'A', '', 'repo.find'),
    ('java', 'method', 'hid', 'hid()', 'priv', 'A', '', ''),
    ('java', 'interface', 'S', 'interface S', 'pub', '', '', ''),
    ('java', 'method', 'm', 'm(int):int', 'pub', 'S', '', ''),
    ('java', 'record', 'P', 'record P', 'pub', '', '', ''),
    ('java', 'enum', 'E', 'enum E', 'pub', '', '', ''),
    ('csharp', 'class', 'K', 'class K', 'pub', '', 'B,IFoo', ''),
    ('csharp', 'const', 'Max', 'Max=3', 'pub', 'K', '', ''),
    ('csharp', 'ctor', 'K', 'K(int)', 'pub', 'K', '', ''),
    ('csharp', 'method', 'RunAsync', 'RunAsync(string,int):Task<List<int>>', 'pub', 'K', '', '_r.Go,BadEx'),
    ('csharp', 'method', 'Hidden', 'Hidden():int', 'priv', 'K', '', ''),
    ('csharp', 'interface', 'IFoo', 'interface IFoo', 'pub', '', '', ''),
    ('csharp', 'method', 'M', 'M(T)', 'pub', 'IFoo', '', ''),
    ('csharp', 'record', 'P', 'record P', 'pub', '', '', ''),
    ('csharp', 'enum', 'E', 'enum E', 'pub', '', '', ''),
    ('kotlin', 'const', 'MAX', 'MAX=3', 'pub', '', '', ''),
    ('kotlin', 'interface', 'I', 'interface I', 'pub', '', '', ''),
    ('kotlin', 'method', 'm', 'm(Int):String', 'pub', 'I', '', ''),
    ('kotlin', 'record', 'D', 'class D', 'pub', '', 'I', ''),
    ('kotlin', 'method', 'm', 'm(Int):String', 'pub', 'D', '', 'helper'),
    ('kotlin', 'method', 'p', 'p()', 'priv', 'D', '', 'BadEx'),
    ('kotlin', 'fn', 'top', 'top(List<Int>,String):Map<String,Int>', 'pub', '', '', 'Repo,r.go'),
    ('scala', 'interface', 'T', 'trait T', 'pub', '', '', ''),
    ('scala', 'method', 'm', 'm(Int):String', 'pub', 'T', '', ''),
    ('scala', 'class', 'C', 'class C', 'pub', '', 'T,U', ''),
    ('scala', 'method', 'm', 'm(Int):String', 'pub', 'C', '', 'help'),
    ('scala', 'method', 'p', 'p()', 'priv', 'C', '', ''),
    ('scala', 'class', 'O', 'object O', 'pub', '', '', ''),
    ('scala', 'method', 'apply', 'apply(List[Int]):C', 'pub', 'O', '', 'C'),
    ('scala', 'record', 'P', 'class P', 'pub', '', '', ''),
    ('swift', 'interface', 'P', 'protocol P', 'pub', '', '', ''),
    ('swift', 'method', 'm', 'm(Int):String', 'pub', 'P', '', ''),
    ('swift', 'class', 'C', 'class C', 'pub', '', 'Base,P', ''),
    ('swift', 'ctor', 'init', 'init(Int)', 'pub', 'C', '', ''),
    ('swift', 'method', 'm', 'm(Int):String', 'pub', 'C', '', 'help'),
    ('swift', 'method', 'q', 'q():Int', 'priv', 'C', '', ''),
    ('swift', 'record', 'S', 'struct S', 'pub', '', '', ''),
    ('swift', 'enum', 'E', 'enum E', 'pub', '', '', ''),
    ('swift', 'fn', 'top', 'top(Int,String):[Int]', 'pub', '', '', 'go'),
    ('php', 'interface', 'I', 'interface I', 'pub', '', '', ''),
    ('php', 'method', 'm', 'm(int):string', 'pub', 'I', '', ''),
    ('php', 'class', 'C', 'class C', 'pub', '', 'B,I', ''),
    ('php', 'const', 'MAX', 'MAX=3', 'pub', 'C', '', ''),
    ('php', 'ctor', '__construct', '__construct(Repo)', 'pub', 'C', '', ''),
    ('php', 'method', 'm', 'm(int,?string):string', 'pub', 'C', '', 'r.go,BadEx'),
    ('php', 'method', 'p', 'p()', 'priv', 'C', '', 'help'),
    ('php', 'fn', 'top', 'top(array):int', 'pub', '', '', ''),
    ('c', 'class', 'S', 'struct S', 'pub', '', '', ''),
    ('c', 'enum', 'E', 'enum E', 'pub', '', '', ''),
    ('c', 'fn', 'hid', 'hid(int):int', 'priv', '', '', 'go'),
    ('c', 'fn', 'run', 'run(struct S *,char *):int *', 'pub', '', '', 'hid'),
    ('c', 'fn', 'noargs', 'noargs()', 'pub', '', '', ''),
    ('cpp', 'class', 'C', 'class C', 'pub', '', 'B,D', ''),
    ('cpp', 'ctor', 'C', 'C(int)', 'pub', 'C', '', ''),
    ('cpp', 'method', 'run', 'run(std::string&):int', 'pub', 'C', '', 'help'),
    ('cpp', 'method', 'p', 'p()', 'priv', 'C', '', ''),
    ('cpp', 'enum', 'E', 'enum E', 'pub', '', '', ''),
    ('cpp', 'method', 'later', 'later(int):int', 'pub', 'C', '', 'BadEx'),
    ('cpp', 'fn', 'top', 'top(std::vector<T>):T', 'pub', '', '', 'v.front'),
    ('go', 'const', 'Max', 'Max=3', 'pub', '', '', ''),
    ('go', 'interface', 'I', 'interface I', 'pub', '', '', ''),
    ('go', 'class', 'T', 'struct T', 'pub', '', '', ''),
    ('go', 'method', 'Run', 'Run(int,...string):(int, error)', 'pub', 'T', '', 't.help'),
    ('go', 'fn', 'New', 'New():*T', 'pub', '', '', ''),
    ('rust', 'const', 'MAX', 'MAX=3', 'pub', '', '', ''),
    ('rust', 'class', 'S', 'struct S', 'pub', '', 'T', ''),
    ('rust', 'enum', 'E', 'enum E', 'pub', '', '', ''),
    ('rust', 'interface', 'T', 'trait T', 'pub', '', '', ''),
    ('rust', 'method', 'm', 'm(i32):String', 'pub', 'T', '', ''),
    ('rust', 'method', 'm', 'm(i32):String', 'priv', 'S', '', 'self.help'),
    ('rust', 'method', 'new', 'new(i32):Self', 'pub', 'S', '', ''),
    ('rust', 'method', 'hid', 'hid()', 'priv', 'S', '', ''),
    ('rust', 'fn', 'go', 'go(&[T]):Result<Vec<T>,Err>', 'pub', '', '', 'run'),
    ('ruby', 'class', 'M', 'class M', 'pub', '', '', ''),
    ('ruby', 'class', 'C', 'class C', 'pub', '', 'B', ''),
    ('ruby', 'ctor', 'initialize', 'initialize(?,?)', 'pub', 'C', '', 'go'),
    ('ruby', 'method', 'run', 'run(?)', 'pub', 'C', '', 'help'),
    ('ruby', 'method', 'hid', 'hid()', 'priv', 'C', '', ''),
    ('ruby', 'fn', 'top', 'top(?)', 'pub', '', '', ''),
    ('lua', 'method', 'run', 'run(?,?)', 'pub', 'M', '', 'help'),
    ('lua', 'fn', 'hid', 'hid(?)', 'priv', '', '', ''),
    ('lua', 'method', 'self', 'self(?)', 'pub', 'M', '', ''),
    ('lua', 'fn', 'top', 'top()', 'pub', '', '', ''),
    ('bash', 'class', 'a.sh', 'a.sh', 'pub', '', '', ''),
    ('bash', 'const', 'MAX', 'MAX=3', 'pub', '', '', ''),
    ('bash', 'method', 'help', 'help()', 'pub', 'a.sh', '', ''),
    ('bash', 'method', 'run', 'run()', 'pub', 'a.sh', '', 'help'),
    ('css', 'fn', '.a', '.a', 'priv', '', '', ''),
    ('css', 'fn', '#b', '#b', 'priv', '', '', ''),
    ('css', 'fn', '--v', '--v', 'priv', '', '', ''),
    ('css', 'fn', 'k', 'k', 'priv', '', '', ''),
    ('html', 'fn', 'my-card', 'my-card', 'priv', '', '', 'my-card'),
    ('html', 'fn', '#x', '#x', 'priv', '', '', ''),
]
