"""Command line entry."""

from tidewell.cli import main

raise SystemExit(main())
