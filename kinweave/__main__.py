"""``python -m kinweave``: generate, worker, merge, validate."""

from kinweave.cli import main

raise SystemExit(main())
