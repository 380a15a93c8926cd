"""A small corpus in several languages."""

FILES = {
    "shop/models.py": '''from dataclasses import dataclass
from enum import Enum

LIMIT = 20
API_KEY = "sk-123456"
NAMES = ["a"]

class Colour(Enum):
    RED = 1
    BLUE = 2

@dataclass
class Order:
    id: int
    owner: "Customer"

class Customer:
    kind = "x"

    def __init__(self, name: str):
        self.name = name

    def total(self, orders: list[Order]) -> int:
        return sum(price(o) for o in orders)

    def _secret(self):
        raise ValueError("no")
''',
    "shop/pricing.py": '''def price(order: "Order", *, rate: float = 1.0) -> int:
    check(order)
    return base_price(order)

def check(order):
    return base_price(order)

def base_price(order):
    return order.id

def never_called():
    return 0
''',
    "shop/app.py": '''from .models import Customer
from . import pricing

def main():
    c = Customer("x")
    c.total([])
    pricing.price(None)
    pricing.base_price(None)
''',
    "tests/test_app.py": '''from shop.app import main

def test_main():
    main()
''',
    "java/Engine.java": '''package a.b;
public interface Engine { int run(int x) throws java.io.IOException; }
''',
    "java/Fast.java": '''package a.b;
/* class Hidden {} */
public class Fast implements Engine {
    public static final int MAX = 7;
    private final Helper helper;
    public Fast(Helper helper) { this.helper = helper; }
    @Override
    public int run(int x) { if (x > MAX) { throw new IllegalStateException("{"); } return helper.help(x, Map.of()); }
    private void hide() { run(1); }
}
''',
    "java/Helper.java": "public record Helper(int a, Map<String, Integer> b) { public int help(int x, Map<String, Integer> m) { return x; } }\n",
    "web/api.ts": '''export interface Api { get(id: string): Promise<string>; }
export class Client implements Api {
  constructor(private url: string) { connect(url); }
  async get(id: string): Promise<string> { return load(id); }
}
export const load = async (id: string): Promise<string> => { return fetchIt(id); };
function fetchIt(id: string): string { return id; }
export type Id = string;
''',
    "go/main.go": '''package main
type Store struct { n int }
func (s *Store) Get(k string) int { return helper(k) }
func helper(k string) int { return 1 }
''',
    "rust/lib.rs": "pub struct P { a: i32 }\nimpl P { pub fn area(&self, k: i32) -> i32 { twice(k) } }\nfn twice(k: i32) -> i32 { k * 2 }\n",
    "Makefile": "CC ?= gcc\n.PHONY: all test\nall: build\n\t$(CC) x.c\nbuild: main.o\n\techo hi\ntest: all\n\t./run\n",
    "chart/Chart.yaml": "name: shop\n",
    "style.css": ".box { color: red }\n#top { --gap: 3px; }\n",
    "run.sh": "#!/bin/bash\nNAME=x\ngo_on() {\n  stop_it\n}\nstop_it() {\n  :\n}\n",
    "node_modules/x.js": "export function hidden() {}\n",
    "README.md": "nothing\n",
}
