"""``python -m regionpanel --snapshot ... --request ... --out ...``: the export job."""

import sys

from regionpanel.plans.job import main

if __name__ == "__main__":
    main(sys.argv[1:])
