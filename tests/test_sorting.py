"""Whole files put in order."""

from arbora.operators import edits, sorting
from arbora.sources import rust

MIXED = """//! Docs.
fn zeta() {}

// about the type
struct Beta;
use std::fmt;
use crate::x::{b, a};
use self::inner::deep;

// loose words

impl Beta {
    fn make() {}
    const N: u8 = 1;
}
mod inner {
    pub fn deep() {}
    pub const A: u8 = 2;
}
const TEN: u8 = 10;
const NINE: u8 = 9;
macro_rules! wall { () => {} }
fn b10() {}
fn b9() {}
"""
SORTED = """//! Docs.
use self::inner::deep;
use crate::x::{b, a};
use std::fmt;

const NINE: u8 = 9;
const TEN: u8 = 10;

// about the type
struct Beta;

// loose words

impl Beta {
    const N: u8 = 1;

    fn make() {}
}

fn zeta() {}

mod inner {
    pub const A: u8 = 2;

    pub fn deep() {}
}

macro_rules! wall { () => {} }

fn b9() {}
fn b10() {}
"""


def sort(spark, text):
    files = spark.createDataFrame([(0, "lib.rs", text)], "crate_id int, path string, text string")
    crates = spark.createDataFrame([(0, "demo", "lib.rs", 2021, [])], "crate_id int, name string, root string, edition int, dependencies array<string>")
    items = rust.workspace(files, crates)["items"]
    done = edits.apply(files.select("path", "text"), sorting.sorted_files(files.select("path", "text"), items)).collect()
    return done[0]["edited"] if done else text


def test_files_are_sorted_and_stay_so(spark):
    assert sort(spark, MIXED) == SORTED
    assert sort(spark, SORTED) == SORTED
