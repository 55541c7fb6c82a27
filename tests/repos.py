"""Small repositories for the tests."""

import subprocess

RESOLVER = {
    "mathutils.py": "def square(x):\n    return x * x\n\n\ndef cube(x):\n    return square(x) * x\n",
    "shapes.py": "import math\nfrom mathutils import square\n\n\nclass Circle:\n    def area(self):\n        return math.pi * square(2)\n\n\ndef describe(shape):\n    return shape.area()\n",
}
BEFORE = {
    "m.py": "def square(x):\n    return x * x\n\n\ndef cube(x):\n    return square(x) * x\n",
    "pkg/__init__.py": "from .conv import pick\n",
    "pkg/conv.py": "def pick(a):\n    return a\n\n\ndef pick(a, b):\n    return b\n",
    "app.py": "import m\nfrom pkg import pick\nfrom legacy import old\n\n\nclass App:\n    def run(self):\n        self.step()\n        return pick(m.cube(2))\n\n    def step(self):\n        old()\n",
    "legacy.py": "def old():\n    return 1\n",
    "web.py": "from fastapi import Depends, FastAPI\nfrom legacy import old\n\napp = FastAPI()\n\n\n@app.get('/old')\ndef read(dep=Depends(old)):\n    return dep\n",
}
AFTER = {
    "m.py": "def square(x):\n    return x * x\n\n\ndef cubed(x):\n    return square(x) * x\n\n\ndef perimeter(x):\n    return 4 * x\n",
    "pkg/__init__.py": BEFORE["pkg/__init__.py"],
    "pkg/conv.py": BEFORE["pkg/conv.py"] + "\n\ndef pick(a, b, c):\n    return c\n",
    "app.py": BEFORE["app.py"],
    "newmod.py": "from m import perimeter\n\n\ndef use():\n    return perimeter(1)\n",
    "web.py": BEFORE["web.py"],
}
FASTAPI = {
    "requirements.txt": "fastapi>=0.1\n",
    "main.py": "from fastapi import FastAPI\nimport routes\nfrom routes import router\n\napp = FastAPI()\napp.include_router(routes.router, prefix='/api')\n\n\n@app.get('/me')\ndef me():\n    return 1\n",
    "routes.py": "from fastapi import APIRouter, Depends\nfrom db import get_db\n\nrouter = APIRouter()\n\n\n@router.post('/charge')\ndef charge(db=Depends(get_db)):\n    return 1\n\n\n@router.post('/refund')\ndef refund(db=Depends(get_db)):\n    return 2\n\n\n@router.get(PATH)\ndef dynamic():\n    return 3\n",
    "db.py": "def get_db():\n    return None\n",
}
ORM = {
    "models.py": (
        "from sqlalchemy import Column, ForeignKey, Integer, String\nfrom sqlalchemy.orm import Mapped, mapped_column, relationship\n\n\n"
        "class User(Base):\n    __tablename__ = 'users'\n    id = Column(Integer, primary_key=True)\n    name = Column(String(50))\n    posts = relationship('Post')\n\n\n"
        "class Post(Base):\n    __tablename__ = 'posts'\n    id: Mapped[int] = mapped_column(primary_key=True)\n    author_id = Column(Integer, ForeignKey('users.id'))\n\n\nclass Plain:\n    x = 1\n"
    ),
}


def write(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return root


def replace(root, files):
    """Makes ``root`` hold exactly these files (but for hidden folders)."""
    for at in [p for p in root.rglob("*") if p.is_file() and not any(x.startswith(".") for x in p.relative_to(root).parts)]:
        if at.relative_to(root).as_posix() not in files:
            at.unlink()
    return write(root, files)


def git(root, *args, at=1_750_000_000, author="Ann"):
    import os

    env = os.environ | {"GIT_AUTHOR_DATE": f"{at} +0000", "GIT_COMMITTER_DATE": f"{at} +0000", "GIT_AUTHOR_NAME": author, "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": author, "GIT_COMMITTER_EMAIL": "a@b.c"}
    return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, text=True, env=env).stdout.strip()


def commit(root, message, at, author="Ann"):
    if not (root / ".git").exists():
        git(root, "init", "-q", "-b", "main")
    git(root, "add", "-A")
    git(root, "commit", "-q", "-m", message, at=at, author=author)
    return git(root, "rev-parse", "HEAD")
