"""Small sources, written for this repository, that inline queries and tests share."""

from __future__ import annotations

SOURCES = {
    "cache.c": """\
// Ring of recent keys.
#include <stdio.h>

/* get the key */
int get_key(int slot) {
    int n = 0; // set n
    // old = lookup(slot);
    // n = old + 1;
    return n;
}
""",
    "pool.cpp": """\
namespace pool {
//////////////////////////
// workers
//////////////////////////
class Pool {
  public:
    /** Number of workers. */
    int size() const { return n_; } // NOLINT
    void add(Worker w) {
        auto done = [&](int k) { return k; }; // first we note it
    }
};
}
""",
    "list.js": """\
/** Adds an item. */
function addItem(item) {
  const url = "http://x/*not a comment*/"; // keep
  const re = /\\/\\/[a-z]/; // a pattern
  return items.map((x) => {
    /* eslint-disable no-console */
    return x;
  });
}
""",
    "shape.ts": """\
// helpers
export class Shape {
  area(): number {
    // TODO: round
    return this.w * this.h;
  }
  scale = (k: number): number => k * 2; // times two
}
""",
    "view.tsx": """\
export function View() {
  return (
    <div>
      {/* Then we show the name */}
      <b>don't</b>
    </div>
  );
}
""",
    "lib.rs": """\
//! Parsing of rows.

/// Reads a row.
pub fn read<'a>(s: &'a str) -> &'a str {
    let c = '"'; // a quote
    /* outer /* inner */ still */
    s.trim()
}
""",
    "main.go": """\
// Package main serves rows.
package main

// Serve answers one call.
func Serve(n int) int {
\t// n is at least one
\treturn n // `raw`
}
""",
    "rows.py": '''\
#!/usr/bin/env python
"""Rows of a table."""


def add_row(row):
    """Adds the row."""
    # add the row
    rows.append(row)  # type: ignore
    return "# not a comment"


class Table:
    """A table."""

    size = 3  # columns
''',
    "Order.java": """\
/** An order. */
public class Order {
    // checkstyle:off
    public int total(int n) throws Exception {
        Runnable r = () -> { go(); }; // deferred
        return n; /* sum */
    }
}
""",
    "Names.cs": """\
using System;
/// <summary>Names.</summary>
class Names {
    string First(string path) {
        // verbatim: no escape here
        return @"c:\\" + path; // joined
    }
}
""",
    "Score.kt": """\
// imports
import kotlin.math.max

/* a /* nested */ block */
fun best(a: Int): Int {
    // max of a and zero because scores are never negative
    return max(a, 0)
}
""",
    "Cart.swift": """\
// MARK: - Cart
struct Cart {
    /// Gets the total.
    func getTotal() -> Int {
        let text = "sum \\(a + "//") end" // shown
        return a
    }
}
""",
}
