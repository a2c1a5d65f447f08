"""Small source files of every language, written for the tests."""

TYPESCRIPT = '''import { open, close as shut } from "node:fs";
import path from 'node:path';
import * as os from "node:os";
import "./side-effect";
export { helper } from "./helper";
// import { fake } from "nowhere";

/** How a lamp is set up. */
export interface LampConfig {
  name: string;
  volts?: number;
}

export enum Mode {
  On = "{",
  Off = "}",
}

/**
 * Lights a room.
 */
export class Lamp extends Base {
  private mode: Mode = Mode.Off;

  constructor(private readonly config: LampConfig) {
    super();
  }

  /** Turn it on. */
  async turnOn(level: number): Promise<void> {
    if (level > 3) {
      this.mode = Mode.On;
    }
  }

  static make(): Lamp {
    return new Lamp({ name: `a ${"{"} b` });
  }
}

export type LampFactory = (config: LampConfig) => Lamp;

export const createLamp: LampFactory = (config) => new Lamp(config);

const DEFAULTS = {
  volts: 12,
};

async function run() {
  const inner = () => 1;
}

export default Lamp;
'''

PYTHON = '''"""Tools for counting.

Second line.
"""
import os
import sys as system
from typing import (
    List,
    Optional as Opt,
)
from .local import thing


@dataclass
class Point:
    """A point."""

    x: int = 0

    def shift(
        self,
        by: int,
    ) -> "Point":
        """Move it."""
        text = """
not indented
"""
        return Point(self.x + by)

    @property
    def hidden(self):
        return 1

    async def wait(self):
        pass


def count(items):
    # a comment
    def nested():
        return {"a": [1, 2]}
    return nested()


VALUE = 3
'''

GO = '''package lamp

import (
	"fmt"
	str "strings"
)

import "os"

// Config holds settings.
// It is small.
type Config struct {
	Name string
}

type Switch interface {
	Flip() error
}

type ID = string

type (
	Alpha struct {
		A int
	}
	Beta int
)

// New makes a lamp.
func New(c *Config) *Lamp {
	return &Lamp{c: c}
}

func (l *Lamp) Flip() error {
	fmt.Println("}")
	return nil
}
'''

JAVA = '''package demo;

import java.util.List;
import static java.util.Map.entry;
import java.io.*;

/** A task. */
@Deprecated
public class Task implements Runnable {
    private String title = "x(";

    /** Make one. */
    public Task(String title) {
        this.title = title;
    }

    @Override
    public void run() {
        if (title != null) {
            helper(1);
        }
    }

    public enum Level { LOW, HIGH }

    static class Inner {
        int value() { return 1; }
    }
}

interface Shape {
    double area();
}

enum Color { RED, GREEN }
'''

KOTLIN = '''package demo

import kotlin.math.max
import demo.util.*

/** A user. */
data class User(
    val name: String,
    val age: Int,
) {
    fun greet(): String = "hi $name"

    /** Older. */
    fun older(): Int {
        return age + 1
    }
}

interface Repo {
    fun find(id: Int): User?
}

object Checker {
    fun check(u: User) = u.age > 0
}

fun String.shout(): String {
    return this.uppercase()
}
'''

RUST = '''use std::collections::HashMap;
use std::io::{self, Read};
use foo as bar;
pub use crate::lamp::*;

/// Settings of a lamp.
/// Two lines.
#[derive(Debug)]
pub struct Config<'a> {
    name: &'a str,
}

pub enum Fault {
    Broken(char),
}

pub trait Light {
    fn on(&self) -> bool;
    fn off(&self) -> bool { !self.on() }
}

impl<'a> Config<'a> {
    /// Make one.
    pub fn new(name: &'a str) -> Self {
        let c = '{';
        Config { name }
    }
}

fn free() -> u8 {
    1
}
'''

C = '''#ifndef LAMP_H
#define LAMP_H
#include <stdio.h>
#include "util.h"

typedef struct {
    int volts;
} Lamp;

typedef int (*handler)(int);
typedef unsigned long volts_t;

/** Start it. */
int lamp_start(Lamp *lamp);
char *lamp_name(const Lamp *lamp);

/** Stop it. */
static int lamp_stop(Lamp *lamp)
{
    if (lamp) {
        return 1;
    }
    return 0;
}
#endif
'''

CPP = '''#include <string>
#include "base.hpp"

/** Things that shine. */
namespace shine {

/** A lamp. */
class Lamp : public Base {
public:
    explicit Lamp(int volts) : volts_(volts) {}
    virtual ~Lamp();
    /** Turn it. */
    int turn(int by) const {
        return by + 1;
    }
    std::string name() const;
private:
    int volts_;
};

template <typename T>
class Registry {
public:
    void add(T item) { items.push_back(item); }
};

int total(int a, int b) {
    return a + b;
}

}  // namespace shine
'''

MARKDOWN = '''# Guide to **lamps**

Intro with a [link](./other.md "title") and ![image](x.png).

## Install

```sh
# not a heading
[no](link)
```

Steps.


Setup notes
-----------

Text `[code](no)` and <https://example.com>.

### Detail ###

## Use

End.
'''

FILES = {
    "typescript": TYPESCRIPT,
    "python": PYTHON,
    "go": GO,
    "java": JAVA,
    "kotlin": KOTLIN,
    "rust": RUST,
    "c": C,
    "cpp": CPP,
    "markdown": MARKDOWN,
}
