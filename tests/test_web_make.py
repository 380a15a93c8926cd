"""Makefiles and modules of web frameworks by hand."""

import pytest

from symscape.sources import make_code, scanners


def by_name(rows):
    return {r["name"]: r for r in rows}


MAKEFILE = r'''# comment: x
CC ?= gcc # the compiler
FLAGS ?= -O2
DIR = build
.PHONY: all test _hidden clean
all: test \
     link | dirs   # more: no
	$(CC) $(FLAGS) -o $@ # $(DIR)
	$(MAKE) -C sub FLAG=1 deploy other
test: ; @echo "# $(FLAGS)" '$(CC)' && $$(DIR) ${NOTSET}
link::
	echo $(patsubst %.c,%.o,$(DIR)) $(CC:.c=.o) $(foreach x,$(FLAGS),$(x))
link::
	echo $(call $(CC))
_hidden clean:
	rm -rf $(DIR)
%.o: %.c
	$(CC) -c $<
$(DIR)/out: all
	touch $@
define BODY
fake: all
	$(CC)
endef
VAR := a:b
.RECIPEPREFIX = >
late: all
> echo $(FLAGS) \
>   $(CC)
ifeq ($(CC),x)
cond: all
endif
'''


def test_make():
    rows = by_name(scanners.make(MAKEFILE, "x/Makefile"))
    assert set(rows) == {"Makefile", "all", "test", "link", "_hidden", "clean", "late", "cond"}
    assert rows["all"]["calls"] == ["test", "link", "dirs", "deploy", "other"] and rows["all"]["param_names"] == ["CC", "FLAGS"] and rows["all"]["size"] == 2
    assert rows["test"]["param_names"] == ["FLAGS", "CC"] and rows["test"]["size"] == 1 and rows["test"]["calls"] == []
    assert rows["link"]["param_names"] == ["CC", "FLAGS"] and rows["link"]["size"] == 2
    assert rows["late"]["param_names"] == ["FLAGS", "CC"] and rows["late"]["visibility"] == "priv" and rows["clean"]["visibility"] == "pub" and rows["_hidden"]["visibility"] == "priv"
    assert rows["all"]["container"] == "Makefile" and rows["all"]["signature"] == "all(CC,FLAGS)"


@pytest.mark.parametrize(("line", "want"), [("a # b", "a "), (r"a \# b # c", r"a \# b "), ("a'#'b", "a'"), ("a#b", "a")])
def test_comments(line, want):
    assert make_code.without_comment(line) == want


@pytest.mark.parametrize(("line", "want"), [("echo '#x' # y", "echo '#x' "), ("a#b", "a#b"), ("#x", ""), (r"echo \' # y", r"echo \' "), ("(#x", "("), ('echo "a \\" # b" # c', 'echo "a \\" # b" ')])
def test_recipe_comments(line, want):
    assert make_code.without_comment(line, recipe=True) == want


def test_references():
    assert make_code.variables("$(A) ${B:.c=.o} $$(C) $$$(D) $(E:x) $(call F,$(G)) $(H $(I)") == ["A", "B", "D", "G", "I"]
    assert make_code.reference_end("$(a ${b} c)", 0) == 10 and make_code.reference_end("$(a", 0) is None
    assert make_code.rule_parts(r"a \; b ; c # d") == (r"a \; b ", " c # d") and make_code.rule_parts("a # ; b") == ("a ", None)
    assert make_code.continues("x\\") and not make_code.continues("x\\\\") and not make_code.continues("x")


WEB = '''import { x } from "y";
export const routes: Routes = [
  { path: "", component: HomeComponent },
  { path: 'users/:id', component: users.UserPage, children: [{ path: "inner", component: Inner }] },
  { path: "lazy", loadChildren: () => import("./lazy") },
];
const plain = [1, 2];
export const Card = React.memo(function Card({ title }: Props) { return draw(title); });
export const Field = forwardRef<HTMLInputElement, P>((props: FieldProps, ref) => { use(ref); return null; });
const List: React.FC<ListProps> = ({ items }) => render(items);
export const api = {
  base: "/x", nested: { get: 1 },
  get(id: string): Item { return fetchItem(id); },
  async list() { throw new ApiError("no"); },
  save: async (item: Item) => { await store.put(item); },
  drop: x => remove(x),
};
const config = { a: 1, b: [2, 3] };
export const add = (a: number, b = 2): number => a + plus(b);
const one = x => x;
export function Outer() { const inner = () => 1; return inner(); }
'''


def test_web_modules():
    rows = scanners.braces(WEB, "typescript")
    got = by_name(rows)
    assert got["routes"]["signature"] == "routes=/→HomeComponent,/users/:id→users.UserPage,/lazy" and got["routes"]["visibility"] == "pub"
    assert got["Card"]["decorators"] == ["memo"] and got["Card"]["calls"] == ["draw"] and got["Card"]["visibility"] == "pub"
    assert got["Field"]["decorators"] == ["forwardRef"] and got["Field"]["params"][0] == "FieldProps"
    assert got["List"]["params"] == ["ListProps"] and got["List"]["signature"] == "List(ListProps)" and got["List"]["visibility"] == "priv"
    members = {r["name"]: r for r in rows if r.get("container") == "api"}
    assert set(members) == {"get", "list", "save", "drop"} and got["api"]["kind"] == "class"
    assert members["get"]["params"] == ["string"] and members["get"]["returns"] == "Item" and members["list"]["raises"] == ["ApiError"] and members["save"]["calls"] == ["store.put"] and members["drop"]["calls"] == ["remove"]
    assert not {"plain", "config", "inner"} & set(got)
    assert got["add"]["params"] == ["number", "?"] and got["add"]["returns"] == "number" and got["one"]["param_names"] == ["x"]
    assert sum(r["name"] == "Card" for r in rows) == 1
